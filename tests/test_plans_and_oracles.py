"""Every registered query: no cartesian/nested-loop joins or row-at-a-time
Python in the plan, single-partition exchanges only where the input is
bounded, and equal results to its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle import compare, duck
from rollcall.plans.registry import QUERIES as OWN

# the package's own queries; the corpus operators have their tests in tests/llm
QUERIES = {n: q for n, q in E.queries().items() if n in OWN}
ORACLES = {n: q for n, q in E.oracle_sql().items() if n in OWN}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
# single-partition exchanges allowed: global aggregates (one partial row per
# task) and windows over one row per task or over the rows of a top-k
GLOBAL_AGGREGATES = {"a1_entity_totals", "a11_weekly_link_stats", "a12_challenge_overview", "q5_search_result_count",
                     "u9_in_batch_counts", "u12_upsert_counts", "u12_create_counts", "u12_update_counts", "u4_partial_update_count",
                     "c20_import_summary", "v9_run_totals", "k2_orphan_counts", "k3_not_null_violations",
                     "k4_length_violations", "k5_cascade_delete_counts", "u10_update_by_occupation_count"}
BOUNDED_WINDOWS = {"a20_slot_order", "v10_progress_trail", "q3_submission_text_sort_positions", "a15_ranked_engagement_export"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["workshop_number", "time_slot_number", "time_slot", "occupation", "count"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    if "SinglePartition" in plan:
        assert name in GLOBAL_AGGREGATES | BOUNDED_WINDOWS, f"{name}: unexpected single-partition exchange"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    problems, _ = compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])
    assert not problems, problems


def test_flagship_scans_are_pruned(spark):
    """The slot-number report reads only the columns it needs from parquet."""
    plan = QUERIES["a16_slot_number_report"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1].split(",")[0:8] for line in plan.splitlines() if "ReadSchema: " in line]
    flat = " ".join(",".join(s) for s in schemas)
    assert "o_orderkey" in flat and "c_mktsegment" in flat
    for unused in ("o_totalprice", "o_orderstatus", "o_orderdate", "c_name", "c_acctbal"):
        assert unused not in flat, unused
    assert "PushedFilters: [IsNotNull(c_custkey)" in plan
