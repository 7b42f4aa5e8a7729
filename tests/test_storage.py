import os

from conftest import SF_SMALL
from rollcall.operators import reports as R
from rollcall.plans.storage import StoredProgramme, store_programme
from rollcall.plans.views import Programme


def test_bucketed_tables_join_without_exchange(spark, scratch):
    store_programme(spark, SF_SMALL, os.path.join(scratch, "warehouse"), database="prog_test", buckets=8)
    stored = StoredProgramme(spark, "prog_test")
    rep = R.slot_number_report(stored.bookings, stored.participants)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at scale: participants is not small
    try:
        plan = rep._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # both inputs of the join on e-mail are read bucket by bucket: no exchange below it
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    joins = [i for i, x in enumerate(lines) if "SortMergeJoin [email" in x]
    assert joins
    for i in joins:
        end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
        assert "Exchange" not in "\n".join(lines[i:end])
    views = Programme(spark, SF_SMALL)
    want = sorted(tuple(r) for r in R.slot_number_report(views.bookings, views.participants).collect())
    assert sorted(tuple(r) for r in rep.collect()) == want
    # the log is partitioned by table: a table filter reads one folder
    log_plan = stored.change_log.filter("table_name = 'weekly'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_name" in log_plan
