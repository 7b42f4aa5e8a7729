import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import changelog as LG
from rollcall.operators import merge as M
from rollcall.sinks import keyed_table as K
from rollcall.sinks import writers as W
from rollcall.streaming import continuous as X

RUN_TS = "2025-01-15 09:30:00"
RUN = dt.datetime(2025, 1, 15, 9, 30)
TARGET_SCHEMA = "k long, v string, reg timestamp_ntz"
BATCH_SCHEMA = "k long, v string, reg timestamp_ntz, row_number long"


def fold(target, batch, mode):
    """Record-at-a-time model of the source system (one statement per record)."""
    state = {k: dict(v=v, reg=reg) for k, v, reg in target}
    ins = upd = 0
    for k, v, reg, _ in sorted(batch, key=lambda r: r[3]):
        if k in state:
            if mode in ("upsert", "update"):
                state[k] = dict(v=v, reg=reg if reg is not None else state[k]["reg"])
                upd += 1
        elif mode in ("upsert", "create"):
            state[k] = dict(v=v, reg=reg if reg is not None else RUN)
            ins += 1
    return sorted((k, d["v"], d["reg"]) for k, d in state.items()), ins, upd


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("mode", ["upsert", "create", "update"])
def test_merge_matches_sequential_fold(spark, seed, mode):
    rnd = random.Random(seed)
    ts = lambda: rnd.choice([None, dt.datetime(2024, 1, rnd.randint(1, 28))])
    target = [(k, rnd.choice([None, f"t{k}"]), dt.datetime(2023, 1, 1)) for k in range(0, 8, 2)]
    batch = [(rnd.randint(0, 9), rnd.choice([None, f"b{i}"]), ts(), i) for i in range(12)]
    res = M.merge_keyed(spark.createDataFrame(target, TARGET_SCHEMA), spark.createDataFrame(batch, BATCH_SCHEMA),
                        ["k"], mode, run_ts=RUN_TS, keep_existing=("reg",), insert_defaults_ts=("reg",),
                        touch_col=None, created_col=None)
    got = sorted(tuple(r) for r in res.state.collect())
    want, ins, upd = fold(target, batch, mode)
    assert got == want
    c = res.counts().first()
    assert (c.inserted, c.updated) == (ins, upd)


def test_change_log_replays_to_new_state(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", None)], TARGET_SCHEMA)
    batch = spark.createDataFrame([(2, "B", None, 1), (3, "c", None, 2)], BATCH_SCHEMA)
    res = M.merge_keyed(before, batch, ["k"], "upsert", run_ts=RUN_TS, touch_col=None, created_col=None)
    log = LG.capture_changes(res.before, res.state, "items", ["k"], RUN_TS,
                             res.outcome.filter(F.col("updated") > 0))
    rows = {r.operation_type: r for r in log.collect()}
    assert set(rows) == {"INSERT", "UPDATE"}
    assert json.loads(rows["UPDATE"].new_values) == {"k": 2, "v": "B", "reg": None}
    assert json.loads(rows["UPDATE"].old_values)["v"] == "b"
    # replay: before + new images of the log == after
    state = {r.k: (r.v, r.reg) for r in before.collect()}
    for r in log.collect():
        img = json.loads(r.new_values)
        state[img["k"]] = (img["v"], img["reg"])
    assert sorted((k, v) for k, (v, _) in state.items()) == sorted((r.k, r.v) for r in res.state.collect())


def test_match_fields_split_by_null_pattern(spark):
    target = spark.createDataFrame([("a@x", "Ann", "o1"), ("b@x", "Bob", "o2")], "email string, name string, occ string")
    batch = spark.createDataFrame([("a@x", None, "n1", 1), ("b@x", "Robert", "n2", 2), ("c@x", "Cy", "n3", 3)],
                                  "email string, name string, occ string, row_number long")
    res = M.merge_on_match_fields(target, batch, ["email", "name"], "upsert", run_ts=RUN_TS, target_key=["email"])
    got = sorted(tuple(r) for r in res.state.collect())
    # a@x matched on e-mail only (name null); c@x is new; b@x did not match (name differs) and its key
    # exists, so it can't be inserted: the stored row stays and the record comes back
    assert got == [("a@x", None, "n1"), ("b@x", "Bob", "o2"), ("c@x", "Cy", "n3")]
    assert [tuple(r) for r in res.rejected.collect()] == [("b@x", 2)]
    c = res.counts().first()
    assert (c.inserted, c.updated) == (1, 1)
    log = {r.operation_type: json.loads(r.new_values) for r in res.changes("items").collect()}
    assert log == {"UPDATE": {"email": "a@x", "name": None, "occ": "n1"}, "INSERT": {"email": "c@x", "name": "Cy", "occ": "n3"}}
    made = M.merge_on_match_fields(target, batch, ["email", "name"], "create", run_ts=RUN_TS, target_key=["email"])
    assert sorted(r.email for r in made.state.collect()) == ["a@x", "b@x", "c@x"]
    assert {r.operation_type for r in made.changes("items").collect()} == {"INSERT"}


def test_versioned_write_is_idempotent(spark, scratch):
    path = os.path.join(scratch, "table")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    v1 = W.write_versioned(df, path, batch_id="1")
    v1b = W.write_versioned(spark.createDataFrame([(9, "z")], "k long, v string"), path, batch_id="1")
    assert v1 == v1b  # replayed batch publishes the same version
    assert [tuple(r) for r in W.read_versioned(spark, path).collect()] == [(1, "a")]
    W.write_versioned(spark.createDataFrame([(2, "b")], "k long, v string"), path, batch_id="2")
    assert [tuple(r) for r in W.read_versioned(spark, path).collect()] == [(2, "b")]


def test_merge_stream_equals_batch_merge(spark, scratch):
    target = spark.createDataFrame([(k, f"t{k}", dt.datetime(2023, 1, 1)) for k in range(0, 20, 2)], TARGET_SCHEMA)
    rnd = random.Random(7)
    batch = [(rnd.randint(0, 25), f"b{i}", rnd.choice([None, dt.datetime(2024, 2, 2)]), i) for i in range(60)]
    src = os.path.join(scratch, "incoming")
    for part in range(3):
        spark.createDataFrame([b for b in batch if b[3] // 20 == part], BATCH_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(src)
    table = os.path.join(scratch, "table")
    K.create(target, table, ["k"], partitions=8)
    opts = dict(keep_existing=("reg",), insert_defaults_ts=("reg",), touch_col=None, created_col=None)
    q = X.merge_stream(spark, src, BATCH_SCHEMA, table, os.path.join(scratch, "log"), "items", ["k"],
                       os.path.join(scratch, "ckpt"), RUN_TS, max_files_per_trigger=1, **opts)
    q.awaitTermination(300)
    assert q.lastProgress is not None and q.lastProgress["batchId"] >= 2  # one batch per file
    streamed = sorted(tuple(r) for r in K.read(spark, table).collect())
    once = M.merge_keyed(target, spark.createDataFrame(batch, BATCH_SCHEMA), ["k"], "upsert", run_ts=RUN_TS, **opts)
    assert streamed == sorted(tuple(r) for r in once.state.collect())
    assert spark.read.parquet(os.path.join(scratch, "log")).count() > 0


def test_validation_streams(spark, scratch):
    pages = spark.createDataFrame(
        [("https://ok.example/p/1", '<button aria-label="Like this article"><span>4</span></button>', 200),
         ("https://ok.example/p/2", "<title>404 Not Found</title>", 200)], "link string, html string, status int")
    subs = [("W1", "a@x", "https://ok.example/p/1"), ("W1", "b@x", "https://ok.example/p/2"),
            ("W2", "c@x", "https://bad.example/p/3"), ("W2", "d@x", "https://ok.example/p/9"), ("W3", "e@x", "")]
    schema = "workshop_name string, email string, project_link string"
    src = os.path.join(scratch, "subs")
    spark.createDataFrame(subs, schema).coalesce(1).write.parquet(src)
    totals = os.path.join(scratch, "totals")
    q = X.validation_totals_stream(spark, src, schema, pages, totals, os.path.join(scratch, "c1"), ["ok.example"])
    q.awaitTermination(300)
    t = W.read_versioned(spark, totals).first()
    assert (t.validated, t.failed, t.updated) == (2, 2, 1)
    out = os.path.join(scratch, "progress")
    q = X.progress_sink(spark, src, schema, pages, out, os.path.join(scratch, "c2"), ["ok.example"])
    q.awaitTermination(300)
    lines = [json.loads(r.value) for r in spark.read.text(os.path.join(out, "*", "*")).collect()]
    assert len(lines) == 5
    assert any(x.get("status") == "Complete" for x in lines)


def test_progress_counters_run_on_over_batches(spark, scratch):
    """One file per micro-batch: every line counts on from the batch before; a batch that runs again gives equal lines."""
    schema = "workshop_name string, email string, project_link string"
    src, out, ckpt = (os.path.join(scratch, x) for x in ("in", "out", "ckpt"))
    pages = spark.createDataFrame([("https://ok.example/1", "<button aria-label='x'>1</button> fine", 200),
                                   ("https://ok.example/2", "404", 200)], "link string, html string, status int")
    for k in range(3):
        spark.createDataFrame([(f"W{k}", f"u{i}@x", f"https://ok.example/{1 + i % 2}" if i < 3 else "https://other/1") for i in range(4)],
                              schema).coalesce(1).write.mode("append").parquet(src)
    q = X.progress_sink(spark, src, schema, pages, out, ckpt, ["ok.example"], max_files_per_trigger=1)
    q.awaitTermination(300)

    def lines():
        return sorted((json.loads(r.value) for r in spark.read.text(os.path.join(out, "*", "*")).collect()),
                      key=lambda x: (x["current"], x["status"] == "Complete"))
    got = lines()
    items = [x for x in got if x["status"] != "Complete"]
    assert [x["current"] for x in items] == list(range(1, 13)) and [x["total"] for x in items] == [4] * 4 + [8] * 4 + [12] * 4
    assert [(x["validated"], x["failed"]) for x in items][3::4] == [(2, 2), (4, 4), (6, 6)]
    assert [(x["current"], x["validated"], x["failed"]) for x in got if x["status"] == "Complete"] == [(4, 2, 2), (8, 4, 4), (12, 6, 6)]
    os.remove(os.path.join(ckpt, "commits", "2"))          # as if the run had ended before the last commit
    crc = os.path.join(ckpt, "commits", ".2.crc")
    if os.path.exists(crc):
        os.remove(crc)
    X.progress_sink(spark, src, schema, pages, out, ckpt, ["ok.example"], max_files_per_trigger=1).awaitTermination(300)
    assert lines() == got


def test_changes_from_merge_equal_before_after_diff(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", None)], TARGET_SCHEMA)
    batch = spark.createDataFrame([(2, "B", None, 1), (3, "c", None, 2), (2, "BB", None, 3), (4, "d", None, 4)],
                                  BATCH_SCHEMA)
    res = M.merge_keyed(before, batch, ["k"], "upsert", run_ts=RUN_TS, touch_col=None, created_col=None)
    direct = sorted(tuple(r) for r in res.changes("items").collect())
    diff = sorted(tuple(r) for r in LG.capture_changes(res.before, res.state, "items", ["k"], RUN_TS,
                                                       res.outcome.filter(F.col("updated") > 0)).collect())
    assert direct == diff
    # key 4 is rewritten with identical values and still logged, like a row trigger
    assert {(r[1], r[2]) for r in direct} == {("UPDATE", "2"), ("INSERT", "3"), ("UPDATE", "4")}


@pytest.mark.parametrize("reset", [False, True])
def test_weekly_reimport_reset_flag(spark, reset):
    target = spark.createDataFrame([(1, "a@x", "g0", True, 5, 2)],
                                   "week_number int, email string, github_link string, valid boolean, likes int, "
                                   "comments int")
    records = spark.createDataFrame([(1, "a@x", "g1", 1)], "week_number int, email string, github_link string, "
                                                           "row_number long")
    batch = M.with_unmapped_counters(records, reset=reset)
    res = M.merge_keyed(target, batch, ["week_number", "email"], "upsert", run_ts=RUN_TS,
                        overwrite=["github_link", "valid", "likes", "comments"],
                        coalesce=("valid", "likes", "comments"), touch_col=None, created_col=None)
    r = res.state.first()
    assert r.github_link == "g1"
    assert (r.valid, r.likes, r.comments) == ((False, 0, 0) if reset else (True, 5, 2))


def test_merge_batch_replay_is_idempotent(spark, scratch):
    table, log = os.path.join(scratch, "t"), os.path.join(scratch, "log")
    K.create(spark.createDataFrame([(1, "a", None)], TARGET_SCHEMA), table, ["k"], partitions=4)
    apply = X.merge_batch_fn(spark, table, log, "items", ["k"], RUN_TS, touch_col=None, created_col=None)
    batch = spark.createDataFrame([(1, "b", None, 1), (2, "c", None, 2)], BATCH_SCHEMA)
    apply(batch, 0)
    first = sorted(tuple(r) for r in K.read(spark, table).collect())
    apply(batch, 0)  # retried after publishing: skipped, nothing read and overwritten
    assert sorted(tuple(r) for r in K.read(spark, table).collect()) == first
    assert spark.read.parquet(os.path.join(log, "stream=batch", "batch=0")).count() == 2
    apply(spark.createDataFrame([(3, "d", None, 1)], BATCH_SCHEMA), 1)
    assert sorted(r.k for r in K.read(spark, table).collect()) == [1, 2, 3]


def test_two_streams_into_one_table(spark, scratch):
    """A second stream starts at batch 0 again: all its rows and log rows arrive beside the first one's."""
    table, log = os.path.join(scratch, "t"), os.path.join(scratch, "log")
    K.create(spark.createDataFrame([(0, "seed", None)], TARGET_SCHEMA), table, ["k"], partitions=8)
    for n in (1, 2):
        src = os.path.join(scratch, f"in{n}")
        spark.createDataFrame([(n * 10 + i, f"s{n}", None, i) for i in range(4)], BATCH_SCHEMA).write.parquet(src)
        X.merge_stream(spark, src, BATCH_SCHEMA, table, log, "items", ["k"], os.path.join(scratch, f"ckpt{n}"), RUN_TS,
                       touch_col=None, created_col=None).awaitTermination(300)
    assert sorted(r.k for r in K.read(spark, table).collect()) == [0, 10, 11, 12, 13, 20, 21, 22, 23]
    assert spark.read.parquet(os.path.join(log, "*", "*")).count() == 8


def test_only_touched_partitions_are_rewritten(spark, scratch):
    table = os.path.join(scratch, "t")
    K.create(spark.range(200).selectExpr("id AS k", "'a' AS v", "CAST(NULL AS TIMESTAMP_NTZ) AS reg"), table, ["k"], partitions=16)
    before = K.manifest(spark, table)
    apply = X.merge_batch_fn(spark, table, os.path.join(scratch, "log"), "items", ["k"], RUN_TS, touch_col=None,
                             created_col=None)
    batch = spark.createDataFrame([(5, "new", None, 1), (1000, "more", None, 2)], BATCH_SCHEMA)
    apply(batch, 0)
    after, parts = K.manifest(spark, table), K.touched(batch, table)
    assert 1 <= len(parts) <= 2
    assert {p for p in after.parts if after.parts[p] != before.parts.get(p)} == {str(p) for p in parts}
    apply(spark.createDataFrame([(5, "newer", None, 1)], BATCH_SCHEMA), 1)
    gone = K.vacuum(spark, table)
    assert gone and not set(gone) & set(K.manifest(spark, table).parts.values())
    rows = {r.k: r.v for r in K.read(spark, table).collect()}
    assert len(rows) == 201 and rows[5] == "newer" and rows[1000] == "more" and rows[7] == "a"


def test_partial_update_folds_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, n int")
    updates = spark.createDataFrame([(1, "x", None, 1), (1, None, 5, 2), (1, "y", None, 3)],
                                    "k long, v string, n int, row_number long")
    state, counts = M.partial_update(target, updates, ["k"], run_ts=RUN_TS, touch_col=None, order_col="row_number")
    assert sorted(tuple(r) for r in state.collect()) == [(1, "y", 5), (2, "b", 20)]
    assert counts.first().updated == 3  # three statements, each setting a field
    unordered, _ = M.partial_update(target, updates.drop("row_number"), ["k"], run_ts=RUN_TS, touch_col=None)
    assert sorted(r.k for r in unordered.collect()) == [1, 2]
