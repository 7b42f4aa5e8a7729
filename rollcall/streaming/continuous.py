"""Structured Streaming entry points.

* X1: import batches arrive as files; each micro-batch is merged into the
  partitions of a keyed table that its keys touch (``sinks.keyed_table``), its
  change rows are written to the log, and the new manifest is published.
  Versions and log folders are named by stream and batch, so a replayed batch
  rewrites the same output and a second stream never meets the first one's.
* X2: running validation totals as a streaming aggregate (complete mode,
  state kept by Spark in the checkpoint), each published as a version of a
  small table.
* X3: a progress sink writing one JSON line per processed item plus a
  summary line per batch.

The signals of the (static) pages are derived and stored once, before the
stream starts, never per batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollcall.functions import messages as MSG
from rollcall.operators import merge as M
from rollcall.operators import validation as V
from rollcall.sinks import keyed_table as K
from rollcall.sinks import writers as W


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that a checkpoint folder belongs to (Spark writes it there when the stream first starts)."""
    return json.loads(W.read_small(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def merge_batch_fn(spark: SparkSession, table_path: str, log_path: str, table: str, keys: list[str],
                   run_ts: str, order_col: str = "row_number", mode: str = "upsert",
                   stream: Callable[[], str] = lambda: "batch", **merge_options):
    """The ``foreachBatch`` body of X1: merge one micro-batch into the table,
    write its change rows, publish the new manifest.

    Idempotent per stream and batch: a batch that the manifest already holds
    is skipped; a retry before publishing reads the previous table again and
    rewrites the same output folders.  The batch never reads a folder it
    writes, and reads and writes only the partitions its keys fall into."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        name = stream()
        if K.applied(spark, table_path, name) >= batch_id:
            return
        parts = K.touched(batch, table_path)
        res = M.merge_keyed(K.read(spark, table_path, parts), batch, keys, mode, run_ts=run_ts, order_col=order_col,
                            **merge_options)
        # state and change rows come from the same merge join: keep it once
        # (a cache, recomputed from lineage if an executor is lost)
        res.applied.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # the log first: it counts only with the manifest that notes the batch
            res.changes(table).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
                .parquet(f"{log_path.rstrip('/')}/stream={name}/batch={batch_id}")
            K.commit(res.state, table_path, parts, name, batch_id)
        finally:
            res.applied.unpersist()

    return apply


def merge_stream(spark: SparkSession, source_dir: str, schema: str, table_path: str, log_path: str,
                 table: str, keys: list[str], checkpoint: str, run_ts: str, order_col: str = "row_number",
                 mode: str = "upsert", max_files_per_trigger: int | None = None,
                 **merge_options) -> StreamingQuery:
    """Continuous keyed merge with change capture into a table that
    ``keyed_table.create`` made with the same keys."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    apply = merge_batch_fn(spark, table_path, log_path, table, keys, run_ts, order_col, mode,
                           lambda: stream_id(spark, checkpoint), **merge_options)
    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stored_signals(spark: SparkSession, pages: DataFrame, **windows) -> DataFrame:
    """The pages' signals, one row per link, written once to the shared folder."""
    path = W.scratch_path(spark, "page-signals")
    signals = V.reduced_signals(V.page_signals(pages, **windows))
    signals.write.parquet(path)
    return spark.read.schema(signals.schema).parquet(path)


def validation_totals_stream(spark: SparkSession, submissions_dir: str, schema: str, pages: DataFrame,
                             out_dir: str, checkpoint: str, domains: list[str], **windows) -> StreamingQuery:
    """Running validated / failed / updated over a stream of submissions
    joined to the (static) fetched pages.  The totals after each micro-batch
    are published as a version of the table under ``out_dir``."""
    signals = stored_signals(spark, pages, **windows)
    subs = spark.readStream.schema(schema).parquet(submissions_dir)
    totals = V.run_totals(V.link_verdicts(subs, domains=domains, signals=signals))

    def publish(batch: DataFrame, batch_id: int) -> None:
        W.write_versioned(batch, out_dir, batch_id=f"{stream_id(spark, checkpoint)}-{batch_id}")

    return (totals.writeStream.outputMode("complete").foreachBatch(publish)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


COUNTERS = ("total", "validated", "failed", "updated")


def progress_sink(spark: SparkSession, submissions_dir: str, schema: str, pages: DataFrame, out_dir: str,
                  checkpoint: str, domains: list[str], link_chars: int | None = None,
                  max_files_per_trigger: int | None = None, **windows) -> StreamingQuery:
    """Per micro-batch, one JSON line per item (with its whole link, or the
    first ``link_chars`` characters) and a summary line, written as text under
    ``out_dir/stream=<id>/batch=N``.

    Every line has current, total, validated, failed and updated over the
    whole stream so far.  The counts behind each batch are stored beside the
    stream's checkpoint before the batch is committed, and a batch starts from
    those of the one before it, so a batch that runs again gives equal lines.
    """
    signals = stored_signals(spark, pages, **windows)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    subs = reader.parquet(submissions_dir)
    link = F.substring("link", 1, link_chars) if link_chars else F.col("link")

    def counts_path(batch_id: int) -> str:
        return f"{checkpoint.rstrip('/')}/progress/batch={batch_id}"

    def emit(batch: DataFrame, batch_id: int) -> None:
        counted = "total long, validated long, failed long, updated long"
        start = dict.fromkeys(COUNTERS, 0)
        if batch_id:
            start = spark.read.schema(counted).parquet(counts_path(batch_id - 1)).first().asDict()
        stream = f"{out_dir.rstrip('/')}/stream={stream_id(spark, checkpoint)}"
        trail = V.progress_trail(V.link_verdicts(batch, domains=domains, signals=signals), ["workshop_name", "email"], link_chars,
                                 ("link", "valid", "reason", "likes", "comments"), start)
        run = trail.agg(F.count(F.lit(1)).alias("total"), *[F.max(c).alias(c) for c in COUNTERS[1:]])
        run = run.select((F.col("total") + start["total"]).alias("total"), *[F.coalesce(c, F.lit(start[c])).alias(c) for c in COUNTERS[1:]])
        run.write.mode("overwrite").parquet(counts_path(batch_id))
        now = spark.read.schema(counted).parquet(counts_path(batch_id))
        items = trail.select(F.to_json(F.struct("workshop_name", "email", link.alias("link"), "valid", "reason", "likes", "comments",
                                                "current", *COUNTERS, "status")).alias("value"))
        summary = now.select(F.to_json(F.struct(
            F.lit(MSG.RUN_COMPLETE).alias("status"), F.col("total").alias("current"), *COUNTERS,
            F.format_string(MSG.RUN_SUMMARY, "validated", "failed", "updated").alias("summary"))).alias("value"))
        items.unionByName(summary).write.mode("overwrite").text(f"{stream}/batch={batch_id}")

    return (subs.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
