"""Findings of round 3: whole import report, sheet rows over many tasks, runs that share files, similar auto-map without a join."""

import glob

from pyspark.sql import functions as F

from rollcall.operators import changelog as LG
from rollcall.operators import headers as H
from rollcall.operators import imports as IM
from rollcall.session import spread
from rollcall.sinks import log_runs
from rollcall.sources import sheets


def test_import_report_has_every_error(spark):
    rows = spark.range(300).select(F.col("id").alias("row_number"))
    rejected = rows.filter("row_number % 2 = 0").select("row_number", F.concat(F.lit("Row "), F.col("row_number")).alias("error"))
    outcome = spark.createDataFrame([(1, 2), (0, 4)], "inserted long, updated long")
    got = IM.import_report(rows, outcome, rejected).collect()
    counts = [r for r in got if r.error is None]
    assert [(r.rows, r.created, r.updated, r.skipped, r.error_count, r.row_number) for r in counts] == [(300, 1, 6, 150, 150, None)]
    assert sorted((r.row_number, r.error) for r in got if r.error) == [(i, f"Row {i}") for i in range(0, 300, 2)]


def test_typed_batch_is_dealt_over_the_tasks(spark):
    batch = spark.range(0, 40, 1, 1).select(
        F.col("id").alias("row_number"), F.concat(F.lit("u"), F.col("id"), F.lit("@x.org")).alias("email"), F.lit("n").alias("name"))
    accepted, _ = IM.generic_import(batch, "participants", {"email": "email", "name": "name"}, 2024, "2025-01-15 09:30:00", materialize=True)
    assert accepted.count() == 40 and accepted.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert spread(batch, "row_number").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_sheet_roles_broadcasts_the_workbooks_not_the_rows(spark):
    rows = spark.range(240).select(
        F.concat(F.lit("w"), F.col("id") % 2).alias("path"), (F.col("id") / 2 % 12).cast("int").alias("sheet_index"), F.lit("s").alias("sheet_name"),
        F.col("id").alias("row_number"), F.array(F.lit("x")).alias("cells"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        roled = sheets.sheet_roles(rows)
        plan = roled._jdf.queryExecution().executedPlan().toString()
        assert roled.filter("role IS NULL").count() == 0 and roled.count() == 240
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "BuildLeft" not in plan


def test_runs_share_files(spark, tmp_path):
    i = F.col("id")
    log = spark.range(600).select(
        i.alias("log_id"), F.lit("a").alias("table_name"), F.when(i % 7 == 0, "DELETE").otherwise("UPDATE").alias("operation_type"),
        F.timestamp_add("MINUTE", F.floor(i / 3).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).cast("timestamp_ntz").alias("log_ts"))
    for at, name in enumerate(("one", "two")):
        log_runs.append(log.filter(F.col("log_id") % 2 == at), str(tmp_path), name, run_rows=5)
    assert len(glob.glob(f"{tmp_path}/rows/two/**/*.parquet", recursive=True)) <= 4
    for offset in (0, 33, 300, 590):
        want = [r.log_id for r in LG.log_page(log, 20, offset).collect()]
        assert [r.log_id for r in log_runs.page(spark, str(tmp_path), 20, offset).collect()] == want


def test_similar_auto_map_needs_no_join(spark):
    names = ["Email", "x", "Email", "E mail", None, "email_id"]
    h = spark.createDataFrame([("f", 0, p, n) for p, n in enumerate(names)] + [(None, 0, 0, "Email"), ("g", 0, 1, "Email"), ("g", 0, 3, "Email")],
                              "path string, sheet_index int, position int, header string")
    got = H.auto_map_similar(h, ["email", "x_1"])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    # the last header that matches wins, a repeated name maps to its first column
    assert sorted((r.path, r.field, r.position) for r in got.collect()) == [("f", "email", 5), ("f", "x_1", 1), ("g", "email", 1)]
