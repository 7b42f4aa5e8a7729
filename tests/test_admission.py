"""Admission, record outcomes and the statement log against record-by-record models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import admission as AD
from rollcall.operators import changelog as LG
from rollcall.operators import imports as IM
from rollcall.operators import merge as M

RUN_TS = "2025-01-15 09:30:00"


@pytest.mark.parametrize("mode", M.MODES)
def test_outcomes_follow_the_records(spark, mode):
    rng = random.Random(4)
    stored = {f"k{i}" for i in range(0, 12, 3)}
    records = [(rng.choice([f"k{i}" for i in range(12)] + ["k1"] * 12), i) for i in range(200)]
    have, want = set(stored), {}
    for key, i in records:
        want[i] = (AD.UPDATED if mode != "create" else AD.UNCHANGED) if key in have else AD.CREATED if mode != "update" else AD.UNCHANGED
        if mode != "update":
            have.add(key)
    target = spark.createDataFrame([(k, "v") for k in stored], "k string, v string")
    out = AD.record_outcomes(spark.createDataFrame(records, "k string, row_number long"), target, ["k"], mode, "row_number")
    assert {r.row_number: r.fate for r in out.collect()} == want


def test_repeated_keys_count_as_records(spark):
    records = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 1)], "email string, row_number long, sheet_index int").withColumn(
        "w", F.lit("W"))
    fates = AD.record_outcomes(records, spark.createDataFrame([], "email string"), ["email"], "upsert", "row_number")
    rows = {r.sheet_index: (r.rows_read, r.inserted, r.updated) for r in IM.workbook_summary(AD.sheet_outcomes(fates, "w")).collect()}
    assert rows == {0: (2, 1, 1), 1: (1, 0, 1), None: (3, 1, 2)}


def test_admission_reasons(spark):
    records = spark.createDataFrame(
        [("a@x", "F", "Ann", 2), ("b@x", "F", None, 3), ("c@x", "F", "n" * 256, 4), ("z@x", "F", "Zoe", 5), (None, "F", "Nil", 6)],
        "email string, form_name string, name string, row_number long")
    parent = spark.createDataFrame([("a@x",), ("b@x",), ("c@x",), ("a@x",)], "email string")
    ok, bad = AD.admit(records, "bookings", parent)
    assert [r.email for r in ok.collect()] == ["a@x"]
    assert {r.row_number: r.error for r in bad.collect()} == {
        3: 'Row 3: null value in column "name" violates not-null constraint',
        4: "Row 4: value too long for type character varying(255)",
        5: 'Row 5: insert or update on table "bookings" violates foreign key constraint',
        6: 'Row 6: null value in column "email" violates not-null constraint'}


def test_parts_add_up_to_the_batch(spark):
    rows = [(f"f{i % 2}", i % 3, i + 2, ["a@x.io", "b@x.io", "bad", "", "c@x.io"][i % 5], "Ann" if i % 4 else "") for i in range(60)]
    batch = spark.createDataFrame(rows, "path string, sheet_index int, row_number long, email string, name string")
    target = spark.createDataFrame([("a@x.io", "W", "Old")], "email string, form_name string, name string")
    done = AD.import_batch(batch, "bookings", {"email": "email", "name": "name"}, target, 2025, RUN_TS, constants={"form_name": "W"},
                           parent=spark.createDataFrame([("a@x.io",), ("b@x.io",)], "email string"), touch_col=None, created_col=None)
    parts = done.summary().collect()
    assert all(r.rows == r.created + r.updated + r.unchanged + r.skipped for r in parts)
    assert sum(r.rows for r in parts) == sum(1 for r in rows if r[3] or r[4])
    totals = done.merged.counts().first()
    assert (sum(r.created for r in parts), sum(r.updated for r in parts)) == (totals.inserted, totals.updated)


def model_log(target, records):
    """Records applied one after another: v is overwritten, kept keeps its value where the record has none."""
    table, out = {k: dict(v=v, kept=kept, other=o, seen=s) for k, v, kept, o, s in target}, []
    for k, v, kept, n in records:
        old = table.get(k)
        if old is None:
            table[k] = dict(v=v, kept=kept, other=None, seen="2025-01-15T09:30:00")
        else:
            table[k] = dict(old, v=v, kept=kept if kept is not None else old["kept"])
        out.append((n, "UPDATE" if old else "INSERT", old, dict(table[k])))
    return out


def test_statement_log_is_a_row_trigger(spark):
    rng = random.Random(9)
    target = [(f"k{i}", "t", "T" if i % 2 else None, "o", None) for i in range(4)]
    records = [(rng.choice(["k0", "k1", "new"] + ["hot"] * 5), rng.choice(["a", "b", None]), rng.choice([None, "x", "y"]), n) for n in range(300)]
    t = spark.createDataFrame(target, "k string, v string, kept string, other string, seen string").withColumn("seen", F.lit(None).cast("timestamp_ntz"))
    b = spark.createDataFrame(records, "k string, v string, kept string, row_number long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = LG.statement_log(t, b, "items", ["k"], RUN_TS, keep_existing=("kept",), insert_defaults_ts=("seen",), touch_col=None, created_col=None)
        got = sorted((r.row_number, r.operation_type, r.old_values, r.new_values) for r in log.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    def plain(text):
        if text is None:
            return None
        d = json.loads(text)
        d.pop("k")
        d["seen"] = d["seen"] and d["seen"].split(".")[0]
        return d
    assert [(n, op, plain(o), plain(a)) for n, op, o, a in got] == model_log(target, records)
