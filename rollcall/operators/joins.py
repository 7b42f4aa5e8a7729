"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast explicitly only when its row count is bounded by
# construction (a LIMIT, a fixed lookup table, a key filter).  Everything else
# is left to Spark's size statistics and AQE.
MAX_BROADCAST_ROWS = 100_000


def optional_col(df: DataFrame, name: str, dtype: str) -> Column:
    """``df[name]`` if present, else a typed null (schemas evolve additively)."""
    if name in df.columns:
        return F.col(name).cast(dtype).alias(name)
    return F.lit(None).cast(dtype).alias(name)


def bounded_broadcast(df: DataFrame, bound: int) -> DataFrame:
    """Broadcast a frame whose row count is bounded by ``bound`` by construction."""
    if bound is None or bound > MAX_BROADCAST_ROWS:
        return df
    return F.broadcast(df)


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after checking it holds at most ``max_rows``
    rows; otherwise return it unchanged so Spark plans a shuffled join.  The
    check reads at most ``max_rows + 1`` rows (a bounded scan)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def enrich_bounded(small: DataFrame, big: DataFrame, key: str, bound: int, how: str = "left") -> DataFrame:
    """``small`` LEFT JOIN ``big`` on ``key`` where ``small`` has at most
    ``bound`` rows.

    The small side's keys are broadcast into a semi-join that filters ``big``
    where it lies (no shuffle of ``big``); the survivors are then joined to
    ``small``."""
    keys = bounded_broadcast(small.select(key).distinct(), bound)
    hits = big.join(keys, key, "left_semi")
    # how many rows of ``big`` share a key is not known here: the planner chooses the join by size
    return small.join(hits, key, how)
