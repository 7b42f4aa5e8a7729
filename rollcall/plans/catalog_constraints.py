"""Registered constraint queries (K1-K6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rollcall import schemas as SC
from rollcall.operators import constraints as K
from rollcall.plans.catalog import prog, query
from rollcall.session import Tables

CHECKED = ["participants", "bookings", "submissions", "weekly", "labs"]


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("k1_duplicate_booking_keys_raw")
def k1(spark, sf):
    """Booking keys of the raw order stream before the one-per-key rule."""
    o = Tables(spark, sf).orders
    raw = o.select(F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                   F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_custkey") % 29 == 0), "Feedback Form")
                   .otherwise(F.concat(F.lit("Workshop "), F.substring("o_orderpriority", 1, 1))).alias("form_name"))
    return K.duplicate_keys(raw, ["email", "form_name"])


@query("k2_orphan_bookings")
def k2(spark, sf):
    p = prog(spark, sf)
    return K.orphans(p.bookings, p.participants)


@query("k2_orphan_counts")
def k2_counts(spark, sf):
    p = prog(spark, sf)
    return _union([K.orphans(getattr(p, t), p.participants).agg(F.count(F.lit(1)).alias("orphans"))
                   .select(F.lit(t).alias("table_name"), "orphans") for t in CHECKED if t != "participants"])


@query("k3_not_null_violations")
def k3(spark, sf):
    p = prog(spark, sf)
    return _union([K.not_null_violations(getattr(p, t), t, SC.NOT_NULL[t]) for t in CHECKED])


@query("k4_length_violations")
def k4(spark, sf):
    p = prog(spark, sf)
    return _union([K.length_violations(getattr(p, t), t, SC.WIDTHS[t]) for t in CHECKED])


@query("k5_cascade_delete_counts")
def k5(spark, sf):
    p = prog(spark, sf)
    deleted = p.participants.filter(F.col("prior_cohort"))
    split = K.split_by_deleted({t: getattr(p, t) for t in CHECKED if t != "participants"}, deleted)
    return split.groupBy("table_name").agg(F.count_if(~F.col("doomed")).alias("kept"))


@query("k5_kept_bookings")
def k5_kept(spark, sf):
    p = prog(spark, sf)
    deleted = p.participants.filter(F.col("prior_cohort"))
    return K.cascade_delete({t: getattr(p, t) for t in CHECKED if t != "participants"}, deleted)["bookings"]


@query("k6_cascade_key_update_bookings")
def k6(spark, sf):
    p = prog(spark, sf)
    renames = p.participants.filter(F.col("designation").isNull()).select(
        F.col("email").alias("old_email"), F.concat(F.lit("renamed."), F.col("email")).alias("new_email"))
    return K.cascade_key_update(p.bookings, renames)


@query("k5_cascade_delete_log")
def k5_log(spark, sf):
    """Deleting the prior-cohort participants: DELETE rows for their bookings,
    submissions, weekly entries and lab proofs (JSON images left out of the
    compared columns)."""
    from rollcall import schemas as S
    from rollcall.plans.catalog import RUN_TS
    p = prog(spark, sf)
    deleted = p.participants.filter(F.col("prior_cohort"))
    tables = [t for t in CHECKED if t != "participants"]
    _, log = K.cascade_delete_logged({t: getattr(p, t) for t in tables}, deleted,
                                     {t: S.PRIMARY_KEYS[t] for t in tables}, RUN_TS)
    return log.select("table_name", "operation_type", "record_identifier", "log_ts",
                      F.col("old_values").isNotNull().alias("has_old"))


@query("k6_cascade_key_update_log")
def k6_log(spark, sf):
    """Renaming the e-mail of participants without a designation: one UPDATE
    row per booking that follows the new key."""
    from rollcall.plans.catalog import RUN_TS
    p = prog(spark, sf)
    renames = p.participants.filter(F.col("designation").isNull()).select(
        F.col("email").alias("old_email"), F.concat(F.lit("renamed."), F.col("email")).alias("new_email"))
    _, log = K.cascade_key_update_logged(p.bookings, renames, "bookings", ["email", "form_name"], RUN_TS)
    return log.select("table_name", "operation_type", "record_identifier", "log_ts",
                      F.get_json_object("old_values", "$.email").alias("old_email"),
                      F.get_json_object("new_values", "$.email").alias("new_email"))
