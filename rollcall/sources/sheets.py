"""Sheet selection and preview over the row shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollcall.functions import messages as MSG
from rollcall.operators.joins import MAX_BROADCAST_ROWS, checked_broadcast
from rollcall.sources.rows import non_blank_cells

# Role of each sheet position in the master workbook.
SHEET_ROLES = [
    ("project", 1), ("form", 1), ("form", 2), ("project", 2), ("form", 3), ("project", 3),
    ("form", 4), ("project", 4), ("form", 5), ("project", 5), ("form", 6), ("project", 6),
]
WEEKLY_SHEET_PATTERN = r"(?i)^(?:\d+\.\s*)?Kiro Week (\d+) Challenge.*"


def scan_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S3: a stored table read with its declared schema; columns added later
    to the schema read as typed nulls from older files."""
    df = spark.read.parquet(path)
    cols = []
    for f in schema.fields:
        cols.append(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def sheet_roles(rows: DataFrame) -> DataFrame:
    """Attach (role, workshop) by sheet position; a workbook with fewer
    than 12 sheets gets ``role_error`` and no roles.  The role table is the
    fixed 12-row list, so it is broadcast."""
    spark = rows.sparkSession
    roles = F.broadcast(spark.createDataFrame([(i, r, w) for i, (r, w) in enumerate(SHEET_ROLES)],
                                              "sheet_index int, role string, workshop int"))
    # one row per workbook: left to the planner, the rows themselves may become the broadcast side or meet in a task per path
    counts = checked_broadcast(rows.groupBy("path").agg(F.count_distinct("sheet_index").alias("sheets")), MAX_BROADCAST_ROWS)
    j = rows.join(counts, "path").join(roles, "sheet_index", "left")
    ok = F.col("sheets") >= len(SHEET_ROLES)
    return j.select(*rows.columns,
                    F.when(ok, F.col("role")).alias("role"), F.when(ok, F.col("workshop")).alias("workshop"),
                    F.when(~ok, F.format_string(MSG.TOO_FEW_SHEETS, F.lit(len(SHEET_ROLES)),
                                                F.col("sheets"))).alias("role_error"))


def weekly_sheets(rows: DataFrame) -> DataFrame:
    """Sheets named like ``Kiro Week N Challenge`` (optionally numbered),
    with the captured week number."""
    week = F.regexp_extract(F.regexp_replace(F.col("sheet_name"), r"(?U)^\s+|\s+$", ""), WEEKLY_SHEET_PATTERN, 1)
    return rows.withColumn("week_number", F.when(week != "", week.try_cast("int"))).filter(F.col("week_number").isNotNull())


def select_sheets(rows: DataFrame, sheet_index: int | None = None, kind: str = "both") -> DataFrame:
    """One sheet by index and/or sheets of a role (form / project / both);
    needs ``role`` from ``sheet_roles`` when ``kind`` is not ``both``."""
    out = rows
    if sheet_index is not None:
        out = out.filter(F.col("sheet_index") == sheet_index)
    if kind in ("form", "project"):
        out = out.filter(F.col("role") == kind)
    return out


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """Per sheet the first ``n`` data rows (blank rows dropped *after* the
    cut) and the total = last row number - 1."""
    totals = rows.groupBy("path", "sheet_index").agg((F.max("row_number") - 1).alias("total_rows"))
    first = rows.filter(F.col("row_number").between(2, n + 1)).filter(non_blank_cells())
    return first.join(totals, ["path", "sheet_index"])
