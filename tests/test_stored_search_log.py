"""The stored change log (pages by counts of runs) and the trigram index against plain scans."""

import os

import pytest
from pyspark.sql import functions as F

from rollcall.operators import changelog as LG
from rollcall.operators import search as S
from rollcall.sinks import log_runs, text_index


@pytest.fixture(scope="module")
def log(spark):
    i = F.col("id")
    return spark.range(600).select(
        i.alias("log_id"), F.element_at(F.array(F.lit("a"), F.lit("b")), (i % 2 + 1).cast("int")).alias("table_name"),
        F.when(i % 7 == 0, "DELETE").otherwise("UPDATE").alias("operation_type"), F.concat(F.lit("r"), i % 5).alias("record_identifier"),
        # ties in time, and rows without one
        F.when(i % 97 != 13, F.timestamp_add("MINUTE", F.floor(i / 3).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
        .cast("timestamp_ntz").alias("log_ts")).cache()


@pytest.fixture(scope="module")
def stored(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    late = (F.col("log_id") % 50 == 3) & (F.col("log_id") < 200)
    for name, part in (("one", (F.col("log_id") < 300) & ~late), ("two", F.col("log_id") >= 300), ("late", late), ("none", F.lit(False))):
        log_runs.append(log.filter(part), path, name, run_rows=40)
    log_runs.append(log.filter(F.col("log_id") >= 300), path, "two", run_rows=40)     # a repeated append
    return path


def _ids(df):
    return [r.log_id for r in df.collect()]


@pytest.mark.parametrize("offset", [0, 8, 39, 311, 590, 700])
def test_pages(spark, log, stored, offset):
    assert _ids(log_runs.page(spark, stored, 25, offset)) == _ids(LG.log_page(log, 25, offset))


def test_filtered_pages(spark, log, stored):
    newest = LG.newest_first
    assert _ids(log_runs.page(spark, stored, 30, 20, operation="DELETE")) == \
        _ids(newest(log.filter("operation_type = 'DELETE'")).offset(20).limit(30))
    assert _ids(log_runs.page(spark, stored, 30, table="a", operation="DELETE")) == _ids(LG.log_by_table(log, "a", 30))
    assert _ids(log_runs.page(spark, stored, 30, table="zz")) == []
    for start, end in (("2024-01-01 00:20:00", "2024-01-01 02:10:30"), ("2024-01-01 02:00:00", None), (None, "2024-01-01 00:05:00")):
        lo, hi = start or "2000-01-01 00:00:00", end or "2100-01-01 00:00:00"
        assert _ids(log_runs.page(spark, stored, 120, start=start, end=end)) == _ids(LG.log_by_time(log, lo, hi, 120))
    with pytest.raises(ValueError):
        log_runs.page(spark, stored, 5, 5, start="2024-01-01 00:00:00")


def test_a_deep_page_reads_few_runs(spark, log, stored):
    page = log_runs.page(spark, stored, 10, 200)
    runs = {os.path.dirname(f) for f in page.inputFiles()}
    assert len(runs) <= 2 and _ids(page) == _ids(LG.log_page(log, 10, 200))


def test_an_unfinished_batch_does_not_count(spark, log, stored, tmp_path):
    path = str(tmp_path)
    log_runs.append(log.filter("log_id < 50"), path, "one", run_rows=20)
    log.withColumn("__run", F.lit(0)).write.partitionBy("__run").parquet(f"{path}/rows/broken")
    assert len(_ids(log_runs.page(spark, path, 100))) == 50
    log_runs.append(log.limit(0), str(tmp_path / "empty"), "one")
    assert _ids(log_runs.page(spark, str(tmp_path / "empty"))) == []
    with pytest.raises(ValueError):
        log_runs.append(log, path, "../up")


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    i = F.col("id")
    people = spark.range(400).select(
        i, F.concat(F.lit("User"), F.lpad(i.cast("string"), 4, "0"), F.lit("@x.org")).alias("email"),
        F.when(i % 9 != 2, F.element_at(F.array(F.lit("Ünï Köde"), F.lit("\U0001f600\U0001f601 smile"), F.lit("two\nlines"), F.lit("")),
                                        (i % 4 + 1).cast("int"))).alias("name"))
    path, columns = str(tmp_path / "index"), ["email", "name"]
    text_index.write(people, path, columns, ["email"], group_rows=25, buckets=8)
    for term in (" USER0123", "r012", "ünï", "\U0001f601 sm", "o\nli", "org ü", "org  ", "x", "", None, "nowhere", "r01z"):
        for trim in (True, False):
            want = {r.id for r in S.search(people, columns, term, trim).collect()}
            got = [r.id for r in text_index.search(spark, path, term, trim).collect()]
            assert sorted(got) == sorted(want), (term, trim)
    assert text_index.candidate_groups(spark, path, "user0123") == [4]
    assert text_index.candidate_groups(spark, path, "ab") is None
    text_index.write(people.limit(0), str(tmp_path / "none"), columns, ["email"])
    assert text_index.search(spark, str(tmp_path / "none"), "abc").count() == 0
    assert text_index.search(spark, str(tmp_path / "none"), "").count() == 0
