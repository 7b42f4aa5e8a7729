"""The change log stored in time-ordered runs (L3-L8 over a large log).

An appended batch is cut into runs of consecutive rows, newest last; a file
holds many runs in order, so a batch has as many files as tasks that wrote
it, however short its runs are.  Beside them stands one row per run, table
and operation with its file, its number of rows and its first and last place
in the log's order (time, nulls newest, then id).
A page is found from these counts: runs whose ranges overlap form a cluster,
clusters follow each other, so the rows before a cluster are known without
reading them, and only the clusters a page touches are read, from their files
and there by run number.  Batches that
arrive in time order give clusters of one run; a late batch joins the runs it
overlaps, which costs reading, never rows.

A batch's folders are named by its id and overwritten as a whole, and a batch
counts only once its run table is written, after its rows: a repeated or
interrupted append changes nothing else.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.changelog import DEFAULT_PAGE, newest_first
from rollcall.operators.ordering import with_position
from rollcall.sinks.writers import exists, list_names, read_small, write_small

RUN_ROWS = 1_000_000
_NEVER = "9999-12-31 23:59:59"


def _place() -> Column:
    """A row's place in the order of the log, oldest first; a null time is the newest."""
    return F.struct(F.col("log_ts").isNull().alias("none"),
                    F.coalesce(F.col("log_ts"), F.lit(_NEVER).cast("timestamp_ntz")).alias("ts"), F.col("log_id").alias("id"))


def _stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("__run", T.LongType())])


def append(log: DataFrame, path: str, batch_id: str, run_rows: int = RUN_ROWS) -> None:
    """Add a batch of change rows (``log_id``, ``log_ts``, ``table_name``, ``operation_type`` and any others)."""
    spark, base = log.sparkSession, path.rstrip("/")
    if not batch_id or not batch_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"batch id {batch_id!r} is no folder name")
    if not exists(spark, f"{base}/schema.json"):
        write_small(spark, f"{base}/schema.json", log.schema.json())
    placed = with_position(log.withColumn("__place", _place()), ["__place"], "__at", start=0) \
        .withColumn("__run", F.floor(F.col("__at") / run_rows))
    # rows without a time are newest of all: in runs of their own they don't stretch the range of the last run
    placed = placed.withColumn("__run", F.when(F.col("log_ts").isNull(), -1 - F.col("__run")).otherwise(F.col("__run")))
    rows = f"{base}/rows/{batch_id}"
    # a run lies in one file
    (placed.repartitionByRange("__run").sortWithinPartitions("__run", "__at").drop("__place", "__at")
     .write.mode("overwrite").parquet(rows))
    stored = spark.read.schema(_stored_schema(log.schema)).parquet(rows)
    (stored.groupBy("__run", F.col("_metadata.file_name").alias("file"), "table_name", "operation_type")
     .agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("lo"), F.max(_place()).alias("hi"))
     .write.mode("overwrite").parquet(f"{base}/runs/{batch_id}"))


def _runs(spark: SparkSession, base: str) -> DataFrame | None:
    """One row per run, table and operation of every finished batch."""
    done = [b for b in list_names(spark, f"{base}/runs") if exists(spark, f"{base}/runs/{b}/_SUCCESS")]
    if not done:
        return None
    out = spark.read.parquet(*[f"{base}/runs/{b}" for b in sorted(done)])
    return out.withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def page_runs(runs: DataFrame, limit: int, offset: int = 0, start: str | None = None, end: str | None = None) -> DataFrame:
    """The runs a page touches: ``batch``, ``file``, ``__run``, ``skipped`` (rows newer than all of their cluster).

    With a time range only rows of runs that lie inside it are sure to count, so the runs at its ends are read as well."""
    lo, hi = F.min("lo").alias("lo"), F.max("hi").alias("hi")
    per_run = runs.groupBy("batch", "file", "__run").agg(F.sum("n").alias("n"), lo, hi)
    if start is not None or end is not None:
        first = F.lit(start or "0001-01-01").cast("timestamp_ntz")
        last = F.lit(end or _NEVER).cast("timestamp_ntz")
        per_run = per_run.filter((F.col("hi.ts") >= first) & (F.col("lo.ts") <= last)).withColumn(
            "n", F.when((F.col("lo.ts") >= first) & (F.col("hi.ts") <= last) & ~F.col("hi.none"), F.col("n")).otherwise(0))
    # these windows are over one row per run
    newest = Window.orderBy(F.col("hi").desc(), "batch", "file", "__run")
    before = newest.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.min("lo").over(before)
    marked = per_run.withColumn("__new", F.when(reach.isNull() | (F.col("hi") < reach), 1).otherwise(0))
    clustered = marked.withColumn("__cluster", F.sum("__new").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = clustered.groupBy("__cluster").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumn("skipped", F.coalesce(F.sum("size").over(
        Window.orderBy("__cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    touched = sizes.filter(F.col("skipped") < offset + limit)
    if start is None and end is None:
        touched = touched.filter(F.col("skipped") + F.col("size") > offset)
    return clustered.join(touched, "__cluster").select("batch", "file", "__run", "skipped")


def page(spark: SparkSession, path: str, limit: int = DEFAULT_PAGE, offset: int = 0, table: str | None = None,
         operation: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """L3-L6 and L8 over the stored log: newest first, ``offset`` rows skipped, ``limit`` returned.  A table filter wins over
    an operation filter; a time range (inclusive; rows without a time are in none) comes without an offset.  A task keeps the
    page and the rows of its clusters before it, however deep the page lies."""
    ranged = start is not None or end is not None
    if ranged and offset:
        raise ValueError("a time range is read from its newest row on")
    base = path.rstrip("/")
    schema = T.StructType.fromJson(json.loads(read_small(spark, f"{base}/schema.json")))
    keep = F.lit(True)
    if table:
        keep = F.col("table_name") == table
    elif operation:
        keep = F.col("operation_type") == operation
    runs = _runs(spark, base)
    # the runs of a page: a few names, or those of one cluster
    found = [] if runs is None else page_runs(runs.filter(keep), limit, offset, start, end).collect()
    if not found:
        return spark.createDataFrame([], schema)
    files = sorted({f"{base}/rows/{r.batch}/{r.file}" for r in found})
    # batches number their runs alike, file names differ; the run numbers alone are pushed down to the files
    in_found = F.concat_ws(":", F.col("_metadata.file_name"), F.col("__run")).isin([f"{r.file}:{r['__run']}" for r in found])
    rows = (spark.read.schema(_stored_schema(schema)).parquet(*files)
            .filter(F.col("__run").isin(sorted({r["__run"] for r in found})) & in_found).filter(keep).select(*schema.names))
    if ranged:
        if start is not None:
            rows = rows.filter(F.col("log_ts") >= F.lit(start).cast("timestamp_ntz"))
        rows = rows.filter(F.col("log_ts") <= F.lit(end or _NEVER).cast("timestamp_ntz"))
        return newest_first(rows).limit(limit)
    ahead = offset - min(r.skipped for r in found)
    rows = newest_first(rows)
    return (rows.offset(ahead) if ahead else rows).limit(limit)

