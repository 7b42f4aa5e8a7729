import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.functions import cleaning as C


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def one_df(spark, transform, value):
    df = spark.createDataFrame([(value,)], "v string")
    return transform(df).select("r").first()["r"]


@pytest.mark.parametrize("value,ok", [
    ("a.b+c@x-y.co.in", True), (" a@b.co ", True), ("a@b", False), ("a b@c.com", False), ("", False), (None, False),
])
def test_email_validity(spark, value, ok):
    assert one(spark, C.is_valid_email, value) is ok


@pytest.mark.parametrize("value,expected", [("+91 98765-43210", "919876543210"), ("12345", None), (None, None)])
def test_phone(spark, value, expected):
    assert one(spark, C.normalize_phone, value) == expected


@pytest.mark.parametrize("value,expected", [
    ("2025-09-12T11:52:26.894Z", dt.datetime(2025, 9, 12, 11, 52, 26, 894000)),
    ("2025-09-12T11:52:26+05:30", dt.datetime(2025, 9, 12, 11, 52, 26)),
    ("2025-09-12T11:52:26.1234567", dt.datetime(2025, 9, 12, 11, 52, 26, 123456)),
    ("01/02/2024", dt.datetime(2024, 2, 1)),
    ("13/25/2024", None),
    ("02/25/2024", dt.datetime(2024, 2, 25)),
    ("25 Nov 2024 14:00", dt.datetime(2024, 11, 25, 14, 0)),
    ("25 November 2024 14:00:00", dt.datetime(2024, 11, 25, 14, 0)),
    ("2024-01-05 10:00", dt.datetime(2024, 1, 5, 10, 0)),
    ("25 Nov 2024", None),
    ("soon", None),
    ("", None),
])
def test_parse_datetime(spark, value, expected):
    assert one_df(spark, lambda d: C.with_datetime(d, "v", "r", 2024), value) == expected


@pytest.mark.parametrize("value,expected", [
    ("25 Nov, 4:00 - 7:00 PM", dt.datetime(2024, 11, 25, 16, 0)),
    ("25 Nov, 4:00 PM - 7:00 PM", dt.datetime(2024, 11, 25, 16, 0)),
    ("25 Nov, 4:00 - 7:00", dt.datetime(2024, 11, 25, 4, 0)),
    ("25 Nov, 11:00 - 1:00 PM", dt.datetime(2024, 11, 25, 23, 0)),
    ("25 November, 16:00-18:00", dt.datetime(2024, 11, 25, 16, 0)),
    ("26 Nov, 10:00 AM - 1:00 PM", dt.datetime(2024, 11, 26, 10, 0)),
    ("tbd", None),
])
def test_time_slot(spark, value, expected):
    assert one_df(spark, lambda d: C.with_time_slot(d, "v", "r", 2024), value) == expected


@pytest.mark.parametrize("value,expected", [
    ("TRUE", True), ("true", True), ("1", True), ("yes", True), ("Y", True), ("on", True),
    ("no", False), ("", False), (None, False), (" true ", False),
])
def test_boolean(spark, value, expected):
    assert one(spark, C.coerce_boolean, value) is expected


@pytest.mark.parametrize("value,expected", [("TRUE", True), ("true", True), ("yes", False), ("1", False)])
def test_boolean_lab(spark, value, expected):
    assert one(spark, C.coerce_boolean_upper_true, value) is expected


@pytest.mark.parametrize("value,expected", [("B.Tech 2024", 2024), ("N/A", None), (None, None)])
def test_year_from_text(spark, value, expected):
    assert one(spark, C.year_from_text, value) == expected


@pytest.mark.parametrize("value,expected", [("2023", 2023), (" 2023 ", 2023), ("B.Tech 2024", None), ("", None)])
def test_strict_int(spark, value, expected):
    assert one(spark, C.strict_int, value) == expected


def test_normalize_string_unicode_whitespace(spark):
    assert one(spark, C.normalize_string, "  x \t") == "x"
    assert one(spark, C.normalize_string, "   ") is None


def test_typed_by_name_order(spark):
    df = spark.createDataFrame([("2024-01-05 10:00", "yes", " 2023 ", " a ")], "a string, b string, c string, d string")
    r = C.with_types_by_name(df, {"updated_at": "a", "validation_reason": "b", "degree_passout_year": "c",
                                  "name": "d"}, 2024).first()
    assert r["updated_at"] == dt.datetime(2024, 1, 5, 10, 0)
    assert r["validation_reason"] is True
    assert r["degree_passout_year"] == 2023
    assert r["name"] == "a"
