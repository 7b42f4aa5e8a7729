"""Merging on match fields against records applied one after another."""

import random

import pytest

from rollcall.operators import merge as M

RUN_TS = "2025-01-15 09:30:00"
SCHEMA = "email string, name string, phone string, note string"


def model(target, records, fields, mode):
    """Rows keep the match values they had when stored or inserted; a record updates every row it agrees with."""
    rows = {r[0]: dict(match=dict(zip(("email", "name", "phone"), r[:3])), now=list(r)) for r in target}
    inserted, updated, rejected = 0, 0, []
    for r in records:
        rec = dict(zip(("email", "name", "phone", "note", "row_number"), r))
        on = [f for f in fields if rec[f] is not None]
        if not on:
            continue
        hit = [x for x in rows.values() if all(x["match"][f] == rec[f] for f in on)]
        if hit:
            if mode != "create":
                for x in hit:
                    x["now"][1:] = r[1:4]
                    updated += 1
        elif mode != "update":
            if rec["email"] in rows:
                rejected.append((rec["email"], rec["row_number"]))
            else:
                rows[rec["email"]] = dict(match={f: rec[f] for f in ("email", "name", "phone")}, now=list(r[:4]))
                inserted += 1
    return sorted(map(str, (x["now"] for x in rows.values()))), inserted, updated, sorted(rejected)


def run(spark, target, records, fields, mode):
    t = spark.createDataFrame(target, SCHEMA)
    b = spark.createDataFrame(records, SCHEMA + ", row_number long").repartition(3)
    res = M.merge_on_match_fields(t, b, fields, mode, run_ts=RUN_TS, target_key=["email"])
    counts = res.counts().first()
    rejected = sorted(map(tuple, res.rejected.collect())) if res.rejected is not None else []
    return sorted(str(list(r)) for r in res.state.collect()), counts.inserted or 0, counts.updated or 0, rejected


def test_a_record_sees_rows_inserted_before_it(spark):
    got = run(spark, [], [("a@x", "Ann", "p2", "first", 1), ("b@x", None, "p2", "second", 2)], ["phone", "name"], "upsert")
    assert got == (["['a@x', None, 'p2', 'second']"], 1, 1, [])


@pytest.mark.parametrize("mode", M.MODES)
@pytest.mark.parametrize("seed", [1, 2])
def test_records_in_file_order(spark, mode, seed):
    rng = random.Random(seed)
    target = [(f"e{i}", rng.choice(["n0", "n1", None]), f"p{i % 3}", "old") for i in range(4)]
    records = [(f"e{rng.randrange(14)}", rng.choice(["n0", "n1", "n2", "n3", None]), rng.choice([f"p{j}" for j in range(8)] + [None] * 3),
                f"r{i}", i) for i in range(120)]
    for fields in (["phone", "name"], ["email", "phone"]):
        assert run(spark, target, records, fields, mode) == model(target, records, fields, mode), fields
