import datetime as dt

from pyspark.sql import functions as F

from rollcall.functions import labels as L
from rollcall.operators import search as S


def test_exact_age_leap_day(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 29),)], "dob date")
    got = df.select(L.exact_age("dob", "2023-02-28").alias("a"), L.exact_age("dob", "2023-03-01").alias("b")).first()
    assert (got.a, got.b) == (22, 23)


def test_age_bands(spark):
    df = spark.createDataFrame([(dt.date(2010, 1, 1),), (dt.date(2000, 6, 30),), (dt.date(1970, 1, 1),), (None,)],
                               "dob date")
    got = [r.b for r in df.select(L.age_band("dob", "2025-06-30").alias("b")).collect()]
    assert got == ["Under 18", "18-25", "Above 50", "Not Specified"]


def test_slot_label_and_order_keys(spark):
    df = spark.createDataFrame([("25 Nov, 4:00 - 7:00 PM", None), ("", dt.datetime(2024, 11, 20, 16, 0)), (None, None)],
                               "time_slot_range string, time_slot timestamp_ntz")
    got = df.select(L.slot_label().alias("l"), L.slot_sort_group().alias("g"), L.slot_sort_date().alias("d")).collect()
    assert [r.l for r in got] == ["25 Nov, 4:00 - 7:00 PM", "2024-11-20 16:00", "No Time Slot"]
    assert [r.g for r in got] == [0, 1, None]
    assert got[0].d == dt.date(2000, 11, 25) and got[1].d == dt.date(2024, 11, 20) and got[2].d is None


def test_dynamic_sort_with_collation(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), (None,)], "name string")
    binary = [r.name for r in S.dynamic_sort(df, "name").collect()]
    assert binary == [None, "A", "a", "b"]  # nulls read as '' and sort first
    unicode = [r.name for r in S.dynamic_sort(df, "name", collation="UNICODE").collect()]
    assert unicode[0] is None and unicode.index("b") == 3


def test_a_value_that_all_rows_share_is_sorted_by_several_tasks(spark):
    df = spark.range(40_000).selectExpr("'w' AS workshop_name", "id", "timestamp_ntz'2025-01-01 00:00:00' AS created_at",
                                        "map('a', id) AS extra")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (S.dynamic_sort(df, "workshop_name", "desc"), S.newest_first(df)):
            at = [r.p for r in out.select(F.spark_partition_id().alias("p")).collect()]
            assert len(at) == 40_000 and max(at.count(p) for p in set(at)) < 30_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sort_keeps_tiebreak_before_the_hash(spark):
    df = spark.createDataFrame([("b", 3), ("A", 2), ("a", 1), (None, 4), ("B", 1)], "workshop_name string, id int")
    got = [(r.workshop_name, r.id) for r in S.dynamic_sort(df, "workshop_name", tiebreak=["id"]).collect()]
    assert got == [(None, 4), ("a", 1), ("A", 2), ("B", 1), ("b", 3)]
    assert S.dynamic_sort(df, "unknown").count() == 5


def test_search_trim_and_nulls(spark):
    df = spark.createDataFrame([("Ann", None), ("Bob", "x@y.io")], "name string, email string")
    assert S.search(df, ["name", "email"], "  ann ").count() == 1
    assert S.search(df, ["name", "email"], "  ann ", trim=False).count() == 0
    assert S.search(df, ["name", "email"], "").count() == 2
