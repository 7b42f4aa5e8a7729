"""Stored programme tables, bucketed by e-mail.

Every join between programme tables is on the participant's e-mail.  Writing
the tables bucketed (and sorted) by e-mail with one common bucket count lets
Spark join them bucket-to-bucket: the sort-merge joins need no exchange, so a
report over participants and bookings shuffles only for its own aggregate.
The change log is partitioned by table name instead (its queries filter on
it, so they read one folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans.views import VIEW_BUILDERS, Programme
from rollcall.session import Tables

EMAIL_TABLES = ["participants", "bookings", "submissions", "weekly", "labs"]


def store_programme(spark: SparkSession, sf_dir: str, location: str, database: str = "programme",
                    buckets: int = 64) -> None:
    """Derive the programme tables from a driver folder and store them under
    ``location`` as tables of ``database``: e-mail keyed tables bucketed by
    e-mail, the change log partitioned by table name, the rest plain."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    t = Tables(spark, sf_dir)
    for name, build in VIEW_BUILDERS.items():
        df = build(t)
        w = df.write.mode("overwrite").format("parquet").option("path", f"{location.rstrip('/')}/{name}")
        if name in EMAIL_TABLES:
            w = w.bucketBy(buckets, "email").sortBy("email")
        elif name == "change_log":
            w = w.partitionBy("table_name")
        w.saveAsTable(f"{database}.{name}")


class StoredProgramme(Programme):
    """The programme tables read from ``store_programme`` output."""

    def __init__(self, spark: SparkSession, database: str = "programme"):
        self.spark = spark
        self.database = database

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_BUILDERS:
            return self.spark.table(f"{self.database}.{name}")
        raise AttributeError(name)
