"""Benchmark the headline queries.

Runs each query fully (``noop`` sink, so every row is computed but nothing is
collected to the driver) at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``:
one warm-up run, then the median of ``$BENCH_REPEATS`` runs.  Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rollcall.plans.registry import QUERIES  # noqa: E402
from rollcall.session import build_session  # noqa: E402

HEADLINE = [
    "a16_slot_number_report",
    "a8_workshop_slot_occupation",
    "a2_city_top20",
    "a13_week_by_week",
    "a15_ranked_engagement_export",
    "a25_participant_summary",
    "q1_submission_search",
    "p3_access_check",
    "u1_upsert_participants",
    "u6_weekly_conflict_merge",
    "l1_change_capture_upsert",
    "c11_c16_import_accepted",
    "c20_import_summary",
    "v4_link_verdicts",
    "v7_marker_folder_check",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(int(cpus) * 2)))
    spark = build_session(f"local[{cpus}]", partitions, app_name="rollcall-bench")
    results = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        run_once(spark, name, sf_dir)
        results[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(repeats)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(results.values()), 3), "unit": "sec",
                      "queries": results, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
