"""Sinks: CSV exports, report grid, JSON lines and versioned tables.

Exports are written by the executors (``DataFrame.write``), never gathered on
the driver.  A versioned table is a folder of immutable versions plus a small
pointer file naming the current one, so a failed or retried batch never
leaves a half-written table visible and a table is never read and
overwritten in place.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import labels as L
from rollcall.operators import reports as R

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Header of the slot-number report grid.
GRID_HEADER = ["Workshop Number", "Time Slot Number", "Time Slot", "Occupation", "Count"]


def _text_cells(df: DataFrame) -> DataFrame:
    """Every column as text: timestamps as ``yyyy-MM-dd HH:mm:ss``, null -> ''."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, TS_FORMAT)
        cols.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*cols)


def workshop_export(bookings: DataFrame, participants: DataFrame, workshop: str,
                    slot: str | None = None) -> DataFrame:
    """O1 rows: the workshop detail, optionally filtered on the *original slot
    text only* (``No Time Slot`` or none = no filter), as text cells."""
    d = R.workshop_detail(bookings, participants, workshop)
    if slot and slot != L.NO_SLOT:
        d = d.filter(F.col("time_slot_range") == slot)
    return _text_cells(d)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Header + rows; nulls and empties as ''.  ``single_file`` coalesces to
    one writer - only for exports known to be small (a report, a top-k)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", "true").option("nullValue", "").option("emptyValue", "")
     .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).csv(path))


def report_grid(report: DataFrame) -> DataFrame:
    """O3 rows: the slot-number report with fixed headers and fills
    ('' / No Time Slot / Unknown / 0)."""
    return report.select(
        F.coalesce(F.col("workshop_number").cast("string"), F.lit("")).alias(GRID_HEADER[0]),
        F.coalesce(F.col("time_slot_number").cast("string"), F.lit("")).alias(GRID_HEADER[1]),
        F.coalesce(F.col("time_slot"), F.lit(L.NO_SLOT)).alias(GRID_HEADER[2]),
        F.coalesce(F.col("occupation"), F.lit(L.UNKNOWN_OCCUPATION)).alias(GRID_HEADER[3]),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias(GRID_HEADER[4]))


def write_grid(report: DataFrame, path: str, clear_first: bool = True) -> None:
    """O3: clear-then-write (overwrite) or append."""
    write_csv(report_grid(report), path, "overwrite" if clear_first else "append")


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row, ISO timestamps, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns),
                               {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"})
                     .alias("value"))


# ---------------------------------------------------------------- O5
POINTER = "_CURRENT"


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def read_small(spark: SparkSession, path: str) -> str:
    """Text of a small file (a pointer or manifest)."""
    fs, p, jvm = file_system(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = file_system(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    fs, p, _ = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = file_system(spark, path)
    fs.delete(p, True)


def current_version(spark: SparkSession, table_path: str) -> str | None:
    pointer = f"{table_path.rstrip('/')}/{POINTER}"
    fs, p, _ = file_system(spark, pointer)
    return json.loads(read_small(spark, pointer))["version"] if fs.exists(p) else None


def publish(spark: SparkSession, table_path: str, version: str) -> None:
    """Point the table at a version: a small file written beside the pointer, then renamed over it."""
    base = table_path.rstrip("/")
    tmp = f"{base}/.{POINTER}.{uuid.uuid4().hex}"
    write_small(spark, tmp, json.dumps({"version": version}))
    fs, src, jvm = file_system(spark, tmp)
    _replace(spark, fs, jvm, src, jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}"))


def read_versioned(spark: SparkSession, table_path: str) -> DataFrame:
    v = current_version(spark, table_path)
    if v is None:
        raise FileNotFoundError(f"no published version under {table_path}")
    return spark.read.parquet(f"{table_path.rstrip('/')}/{v}")


def write_versioned(df: DataFrame, table_path: str, partition_by: list[str] | None = None,
                    batch_id: str | None = None) -> str:
    """Write a new immutable version, then publish it by replacing the
    pointer (a small file written next to it and renamed).  A batch id makes
    the write idempotent: re-running the same batch publishes the same
    version folder."""
    spark = df.sparkSession
    version = f"v-{batch_id}" if batch_id else f"v-{uuid.uuid4().hex}"
    target = f"{table_path.rstrip('/')}/{version}"
    fs, _, jvm = file_system(spark, table_path)
    done = jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    if not fs.exists(done):
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(target)
    publish(spark, table_path, version)
    return version


def _replace(spark: SparkSession, fs, jvm, src, dst) -> None:
    """Move ``src`` over ``dst`` in one rename where the file system allows it
    (``FileContext`` with OVERWRITE, atomic on HDFS); otherwise delete and
    rename."""
    try:
        fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(),
                                                                 spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        gateway = spark.sparkContext._gateway
        opts = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = overwrite
        fc.rename(src, dst, opts)
    except Exception:
        fs.delete(dst, False)
        fs.rename(src, dst)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    from rollcall.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "rollcall", f"{name}-{uuid.uuid4().hex[:12]}")
