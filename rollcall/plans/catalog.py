"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query binds an operator of the package to the programme tables derived
from the driver's parquet folder (``plans.views``).  Parameters that the
reference takes from the clock (age reference day, slot year, run time) are
fixed here so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans.views import Programme

# Fixed parameters of the registered queries.
AS_OF = "2025-06-30"
WEEK = 2
WORKSHOP = "Workshop 1"
TOP_LIMIT = 10
EXPORT_LIMIT = 25
SLOT_YEAR = 2024
RUN_TS = "2025-01-15 09:30:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def prog(spark: SparkSession, sf_dir: str) -> Programme:
    return Programme(spark, sf_dir)
