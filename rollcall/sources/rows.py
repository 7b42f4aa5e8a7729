"""The common shape of imported files: one row per sheet row.

Every file source (delimited files, workbooks) yields
``(path, sheet_index, sheet_name, row_number, cells array<string>)`` with the
header at row 1, so header mapping and cleaning work the same for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.joins import bounded_broadcast

ROWS_SCHEMA = "path string, sheet_index int, sheet_name string, row_number long, cells array<string>"


def number_rows(df: DataFrame, by: str, name: str = "row_number", start: int = 1, files: int = 1) -> DataFrame:
    """Dense row numbers per ``by`` value in input order, without a global
    sort or a single-partition window.

    ``monotonically_increasing_id`` is consecutive inside a partition, so a
    row's index is its id minus the first id of its (file, partition) run;
    the runs' sizes get a prefix sum per file (one small table, one row per
    input split).  File splits are deterministic, so a recomputed partition
    gets the same numbers.

    Precondition: ``df`` comes straight from a file scan (no shuffle before
    it).  Partition ids are read by two branches; after a shuffle AQE could
    coalesce partitions differently in each (checkpoint such an input first,
    as ``operators.validation.progress_trail`` does)."""
    d = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__pid", F.spark_partition_id())
    runs = d.groupBy(by, "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    w = Window.partitionBy(by).orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(by, "__pid", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    # a split holds a run of each of its files, so there are at most as many runs as splits and files together
    j = d.join(bounded_broadcast(offsets, df.rdd.getNumPartitions() + files), [by, "__pid"])
    return j.withColumn(name, (F.col("__off") + F.col("__id") - F.col("__first") + start).cast("long")) \
        .drop("__id", "__pid", "__first", "__off")


def non_blank_cells() -> "F.Column":
    """C12 on the row shape: some cell is non-empty."""
    # joined text of the cells (nulls skipped) is non-empty iff some cell is
    return F.coalesce(F.array_join(F.col("cells"), ""), F.lit("")) != ""


def headers(rows: DataFrame) -> DataFrame:
    """H1: the header row exploded to (path, sheet_index, position, header),
    trimmed, null -> ''."""
    return (rows.filter(F.col("row_number") == 1)
            .select("path", "sheet_index", "sheet_name", F.posexplode("cells").alias("position", "raw"))
            .select("path", "sheet_index", "sheet_name", "position",
                    F.coalesce(F.regexp_replace(F.col("raw"), r"(?U)^\s+|\s+$", ""), F.lit("")).alias("header")))


def materialized_headers(rows: DataFrame) -> DataFrame:
    """The header table, written once (reliable checkpoint in the shared
    checkpoint folder).  It has one row per sheet column, but deriving it
    scans every row of every file; the header operators read it several
    times (validation, lookups, the auto-map rounds), so it is cut from the
    scan instead of being recomputed per use."""
    from rollcall.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(rows.sparkSession)
    return headers(rows).checkpoint(eager=True)


def data_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("row_number") >= 2)


def rows_from_frame(df: DataFrame, headers_: list[str], cells: list, path, sheet_index, sheet_name,
                    row_number) -> DataFrame:
    """A DataFrame laid out as sheet rows: one header row (row 1) per sheet
    with ``headers_`` and one data row per input row with ``cells`` as text.
    The header rows come from the distinct sheets (one per sheet), so the
    result grows only with the data."""
    data = df.select(path.alias("path"), sheet_index.cast("int").alias("sheet_index"),
                     sheet_name.alias("sheet_name"), row_number.cast("long").alias("row_number"),
                     F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("cells"))
    heads = (data.select("path", "sheet_index", "sheet_name").distinct()
             .select("path", "sheet_index", "sheet_name", F.lit(1).cast("long").alias("row_number"),
                     F.array(*[F.lit(h) for h in headers_]).alias("cells")))
    return heads.unionByName(data)
