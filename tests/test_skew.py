"""Hot keys: one key holding a third of all rows must be reduced before any
shuffle or window, and results must stay whole and exact."""

import datetime as dt

from pyspark.sql import functions as F

from rollcall.operators import merge as M
from rollcall.operators import reports as R

RUN_TS = "2025-01-15 09:30:00"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_in_merge_batch(spark):
    n = 3000
    # key 0 holds a third of the batch
    batch = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                  F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"),
                                  F.lit(None).cast("timestamp_ntz").alias("reg"), F.col("id").alias("row_number"))
    target = spark.createDataFrame([(0, "old", dt.datetime(2023, 1, 1))], "k long, v string, reg timestamp_ntz")
    res = M.merge_keyed(target, batch, ["k"], "upsert", run_ts=RUN_TS, keep_existing=("reg",),
                        insert_defaults_ts=("reg",), touch_col=None, created_col=None)
    hot = res.state.filter(F.col("k") == 0).first()
    assert hot.v == f"v{n - 3}" and hot.reg == dt.datetime(2023, 1, 1)  # last record wins, stored time kept
    c = res.counts().first()
    assert c.inserted == n - n // 3 and c.updated == n // 3  # every record counted, none dropped
    assert res.state.count() == 1 + (n - n // 3)
    plan = _plan(res.state)
    # the batch is combined per key before its shuffle
    assert "partial_max_by" in plan


def test_hot_workshop_ranked_after_aggregation(spark):
    rows = [(f"u{i}@x", "Workshop 1" if i % 3 else f"Workshop {2 + i % 4}", dt.datetime(2024, 11, 20 + i % 5), None)
            for i in range(900)]
    bookings = spark.createDataFrame(rows, "email string, form_name string, time_slot timestamp_ntz, "
                                           "time_slot_range string")
    participants = spark.createDataFrame([(f"u{i}@x", "Student" if i % 2 else "") for i in range(900)],
                                         "email string, occupation string")
    rep = R.slot_number_report(bookings, participants)
    got = {(r.workshop_number, r.time_slot_number, r.occupation): r["count"] for r in rep.collect()}
    assert sum(got.values()) == 900
    assert {k[1] for k in got if k[0] == 1} == {1, 2, 3, 4, 5}
    plan = _plan(rep)
    # the rank window sorts the distinct dates of a workshop, right above their aggregate
    below = plan[plan.index("Window"):]
    keys = below[below.index("HashAggregate(keys=["):].split("]")[0]
    assert "slot_date" in keys and "occupation" not in keys and "time_slot" not in keys


def test_progress_trail_complete_over_many_partitions(spark):
    n = 50000
    verdicts = spark.range(n).repartition(32).select(
        F.lit("W").alias("workshop_name"), F.format_string("u%06d@x", "id").alias("email"),
        F.lit("https://ok.example/p").alias("link"), (F.col("id") % 3 != 0).alias("valid"),
        F.lit("Verified").alias("reason"), (F.col("id") % 2).cast("int").alias("likes"),
        F.lit(0).alias("comments"))
    from rollcall.operators import validation as V
    trail = V.progress_trail(verdicts, ["workshop_name", "email"])
    stats = trail.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("current").alias("d"),
                      F.min("current").alias("lo"), F.max("current").alias("hi"),
                      F.max("validated").alias("ok"), F.max("failed").alias("bad")).first()
    assert (stats.n, stats.d, stats.lo, stats.hi) == (n, n, 1, n)
    assert stats.ok + stats.bad == n
    # running counts follow the order: item k has seen exactly k items
    last = trail.filter(F.col("email") == "u049999@x").first()
    assert last.current == n and last.validated + last.failed == n


def test_hot_match_value_is_reduced_before_the_join(spark):
    """U10 with one match value shared by 3000 records and 1000 target rows:
    the count is records x rows hit (3,000,000) but the join emits only the
    1000 rows to update."""
    target = spark.range(1000).select(F.format_string("u%d@x", "id").alias("email"), F.lit("HOT").alias("occ"),
                                      F.lit("old").alias("desig"))
    batch = spark.range(3000).select(F.lit("HOT").alias("occ"), F.format_string("d%d", "id").alias("desig"),
                                     F.col("id").alias("row_number"))
    res = M.merge_on_match_fields(target, batch, ["occ"], "update", run_ts=RUN_TS, target_key=["email"])
    assert {r.desig for r in res.state.collect()} == {"d2999"}
    assert res.counts().first().updated == 3000 * 1000
    plan = _plan(res.state)
    # the batch side is aggregated per match value before it meets the target
    assert "partial_max_by" in plan and "CartesianProduct" not in plan
