"""Stage timings of one registered query from Spark's event log.

    python profile_query.py a16_slot_number_report [/root/testdata/sf0.1]

Runs the query twice (warm-up, then measured) to a ``noop`` sink with the
event log written to a fresh scratch folder, and prints the measured run's
stages: name, tasks and wall time.  No UI or server is started.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from rollcall.session import SESSION_CONF  # noqa: E402


def _events(folder: str):
    import zstandard
    for fn in sorted(glob.glob(os.path.join(folder, "**", "events_*"), recursive=True)):
        raw = open(fn, "rb").read()
        if fn.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "ignore").splitlines():
            try:
                yield json.loads(line)
            except ValueError:
                continue


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    builder = (SparkSession.builder.master("local[8]").config("spark.eventLog.enabled", "true")
               .config("spark.eventLog.dir", log_dir).config("spark.sql.shuffle.partitions", "16"))
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from rollcall.plans.registry import QUERIES
    marks = []
    for _ in range(2):
        marks.append(int(time.time() * 1000))
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        elapsed = time.perf_counter() - t0
    spark.stop()
    print(f"{name}: {elapsed:.2f} s (second run)")
    for e in _events(log_dir):
        if e.get("Event") == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            if si.get("Submission Time", 0) >= marks[1]:
                took = si.get("Completion Time", 0) - si.get("Submission Time", 0)
                print(f"  stage {si['Stage ID']:>4}  tasks {si['Number of Tasks']:>4}  {took:>6} ms  "
                      f"{si['Stage Name'][:60]}")


if __name__ == "__main__":
    main()
