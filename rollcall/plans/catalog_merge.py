"""Registered merge (U), change-capture (L1, L2) and import (C) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import cleaning as C
from rollcall.operators import admission as AD
from rollcall.operators import changelog as LG
from rollcall.operators import imports as IM
from rollcall.operators import merge as M
from rollcall.plans.catalog import RUN_TS, SLOT_YEAR, prog, query
from rollcall.session import Tables

PARTICIPANT_KEYS = ["email"]


def participant_batch(p):
    """A participant import batch derived from the submissions: one record per
    submission, in file order = workshop number, so an e-mail may repeat."""
    s = p.submissions
    return s.select(
        "email", "name",
        F.substring("workshop_name", 10, 3).cast("int").alias("row_number"),
        F.when(F.col("comments") == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("created_at")).alias("registration_date_time"),
        F.col("team_id").alias("occupation"),
        F.when(F.col("likes") % 2 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("77"), F.col("likes").cast("string"))).alias("phone_number"),
    )


def _participant_merge(p, mode):
    return M.merge_keyed(p.participants, participant_batch(p), PARTICIPANT_KEYS, mode, run_ts=RUN_TS,
                         keep_existing=("registration_date_time",), insert_defaults_ts=("registration_date_time",),
                         defaults={"prior_cohort": F.lit(False)}, touch_col=None, created_col=None)


@query("u1_upsert_participants")
def u1(spark, sf):
    return _participant_merge(prog(spark, sf), "upsert").state


@query("u2_create_participants")
def u2(spark, sf):
    return _participant_merge(prog(spark, sf), "create").state


@query("u3_update_participants")
def u3(spark, sf):
    return _participant_merge(prog(spark, sf), "update").state


@query("u12_upsert_counts")
def u12(spark, sf):
    return _participant_merge(prog(spark, sf), "upsert").counts()


@query("u12_create_counts")
def u12_create(spark, sf):
    return _participant_merge(prog(spark, sf), "create").counts()


@query("u12_update_counts")
def u12_update(spark, sf):
    return _participant_merge(prog(spark, sf), "update").counts()


@query("u4_partial_update_submissions")
def u4(spark, sf):
    p = prog(spark, sf)
    updates = p.labs.select("workshop_name", "email", F.col("proof_link").alias("project_link"), "valid")
    state, _ = M.partial_update(p.submissions, updates, ["workshop_name", "email"], run_ts=RUN_TS, touch_col=None)
    return state


@query("u4_partial_update_count")
def u4_count(spark, sf):
    p = prog(spark, sf)
    updates = p.labs.select("workshop_name", "email", F.col("proof_link").alias("project_link"), "valid")
    _, counts = M.partial_update(p.submissions, updates, ["workshop_name", "email"], run_ts=RUN_TS, touch_col=None)
    return counts


def weekly_batch(spark, sf):
    """A weekly re-import derived from the events: new repository
    links, likes sometimes missing, no validity or comments."""
    e = Tables(spark, sf).events
    eid = F.col("event_id")
    return (e.select((F.floor((F.dayofmonth("ts") - 1) / 7).cast("int") + 1).alias("week_number"),
                    F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
                    F.concat(F.lit("https://github.com/new/"), eid.cast("string")).alias("github_link"),
                    F.lit(None).cast("string").alias("blog_link"),
                    F.lit(None).cast("boolean").alias("valid"),
                    F.when(eid % 3 == 0, F.lit(None).cast("int")).otherwise((eid % 100).cast("int")).alias("likes"),
                    F.lit(None).cast("int").alias("comments"),
                    F.lit(None).cast("boolean").alias("github_valid"),
                    F.col("ts").alias("created_at"),
                    eid.alias("row_number")))


@query("u6_weekly_conflict_merge")
def u6(spark, sf):
    p = prog(spark, sf)
    return M.merge_keyed(p.weekly, weekly_batch(spark, sf), ["week_number", "email"], "upsert", run_ts=RUN_TS,
                         overwrite=["github_link", "blog_link", "valid", "likes", "comments"],
                         coalesce=("valid", "likes", "comments"), first_cols=("created_at",),
                         touch_col=None).state


def new_grants(spark, sf):
    """A grant per line item: the part after the one that was delivered."""
    li = Tables(spark, sf).lineitem
    return li.select(F.col("l_suppkey").alias("user_id"), (F.col("l_partkey") + F.col("l_linenumber")).alias("permission_id"))


@query("u8_insert_or_ignore_grants")
def u8(spark, sf):
    p = prog(spark, sf)
    new = new_grants(spark, sf)
    return M.insert_or_ignore(p.access_grants, new, ["user_id", "permission_id"])


@query("u15_delete_feedback_participants")
def u15(spark, sf):
    p = prog(spark, sf)
    doomed = p.bookings.filter(F.col("form_name") == "Feedback Form").select("email")
    return M.delete_by_keys(p.participants, doomed, ["email"])


@query("u16_replace_grant_sets")
def u16(spark, sf):
    p = prog(spark, sf)
    new = new_grants(spark, sf)
    return M.replace_sets(p.access_grants, new)


@query("u17_grant_all_to_user")
def u17(spark, sf):
    p = prog(spark, sf)
    return M.grant_all(p.access_grants, p.access_permissions, 7)


def _match_on_name(p, mode):
    """Match participants on (email, name) where present: a record without a
    name matches on e-mail only (U9); one with a name that differs from the
    stored one matches nothing and cannot be inserted where the e-mail exists."""
    batch = participant_batch(p).withColumn(
        "name", F.when(F.col("row_number") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("name")))
    return M.merge_on_match_fields(p.participants.select("email", "name", "occupation", "phone_number"),
                                   batch.select("email", "name", "occupation", "phone_number", "row_number"),
                                   ["email", "name"], mode, run_ts=RUN_TS, target_key=["email"])


@query("u9_match_on_name_upsert")
def u9(spark, sf):
    return _match_on_name(prog(spark, sf), "update").state


@query("u9_upsert")
def u9_upsert(spark, sf):
    return _match_on_name(prog(spark, sf), "upsert").state


@query("u9_create")
def u9_create(spark, sf):
    return _match_on_name(prog(spark, sf), "create").state


@query("u9_rejected")
def u9_rejected(spark, sf):
    return _match_on_name(prog(spark, sf), "upsert").rejected


@query("u9_in_batch_counts")
def u9_counts(spark, sf):
    return _match_on_name(prog(spark, sf), "upsert").counts()


PARTICIPANT_IMAGE = ["email", "name", "occupation", "phone_number"]


def _images(log, fields):
    """Change rows with the fields of both images."""
    return log.select("table_name", "operation_type", "record_identifier", "log_ts",
                      *[F.get_json_object(f"{side}_values", f"$.{f}").alias(f"{side}_{f}")
                        for side in ("old", "new") for f in fields])


@query("u9_changes")
def u9_changes(spark, sf):
    return _images(_match_on_name(prog(spark, sf), "upsert").changes("participants"), PARTICIPANT_IMAGE)


@query("l1_change_capture_upsert")
def l1(spark, sf):
    p = prog(spark, sf)
    return _images(_participant_merge(p, "upsert").changes("participants"), [*PARTICIPANT_IMAGE, "city", "prior_cohort"])


@query("l1_statement_log")
def l1_statements(spark, sf):
    """One change row per record of the participant import, with the images before and after that record."""
    p = prog(spark, sf)
    log = LG.statement_log(p.participants, participant_batch(p), "participants", PARTICIPANT_KEYS, RUN_TS,
                           keep_existing=("registration_date_time",), insert_defaults_ts=("registration_date_time",),
                           defaults={"prior_cohort": F.lit(False)}, touch_col=None, created_col=None)
    fields = [*PARTICIPANT_IMAGE, "city", "registration_date_time", "prior_cohort"]
    return log.select("operation_type", "record_identifier", "row_number",
                      *[F.get_json_object(f"{side}_values", f"$.{f}").cast("timestamp_ntz" if f.endswith("_time") else "string")
                        .alias(f"{side}_{f}") for side in ("old", "new") for f in fields])


@query("l2_record_identifiers")
def l2(spark, sf):
    p = prog(spark, sf)
    return (p.weekly.select(F.lit("weekly").alias("table_name"), LG.record_identifier("weekly").alias("rid"))
            .unionByName(p.bookings.select(F.lit("bookings").alias("table_name"),
                                           LG.record_identifier("bookings").alias("rid")))
            .unionByName(p.submissions.select(F.lit("submissions").alias("table_name"),
                                              LG.record_identifier("submissions").alias("rid"))))


# ---------------------------------------------------------------- imports (C)
@query("c1_c4_clean_contacts")
def c1_c4(spark, sf):
    r = prog(spark, sf).raw_rows
    return r.select("row_number_in_file",
                    C.normalize_string("name").alias("name"),
                    C.normalize_email("email").alias("email_key"),
                    C.is_valid_email("email").alias("email_valid"),
                    C.normalize_phone("phone").alias("phone"))


@query("c5_c6_parse_created")
def c5(spark, sf):
    r = prog(spark, sf).raw_rows.select("row_number_in_file", "created_text")
    r = C.with_datetime(r, "created_text", "created_at", SLOT_YEAR)
    return r.withColumn("created_iso", C.parse_iso_naive(C.strip("created_text")))


@query("c7_c8_parse_slot")
def c7(spark, sf):
    r = prog(spark, sf).raw_rows.select("row_number_in_file", "slot_text")
    r = C.with_time_slot(r, "slot_text", "time_slot", SLOT_YEAR)
    return r.select("row_number_in_file", "time_slot", C.normalize_string("slot_text").alias("time_slot_range"))


@query("c9_c10_flags_and_years")
def c9(spark, sf):
    r = prog(spark, sf).raw_rows
    return r.select("row_number_in_file",
                    C.coerce_boolean("flag_text").alias("flag"),
                    C.coerce_boolean(F.col("row_number_in_file") % 3).alias("flag_number"),
                    C.coerce_boolean((F.col("row_number_in_file") % 4).cast("double") / 2).alias("flag_half"),
                    C.coerce_boolean_upper_true("flag_text").alias("flag_lab"),
                    C.year_from_text("degree_text").alias("year_sheet"),
                    C.strict_int("degree_text").alias("year_generic"))


IMPORT_MAPPING = {
    "email": "email", "name": "name", "phone_number": "phone", "registration_date_time": "created_text",
    "participated_in_academy_1_0": "flag_text", "degree_passout_year": "degree_text",
}


def _raw_import(spark, sf, materialize=False):
    r = prog(spark, sf).raw_rows.withColumnRenamed("row_number_in_file", "row_number")
    return IM.generic_import(r, "participants", IMPORT_MAPPING, SLOT_YEAR, RUN_TS,
                             defaults=["registration_date_time"], materialize=materialize)


@query("c11_c16_import_accepted")
def c11(spark, sf):
    return _raw_import(spark, sf)[0]


@query("c15_import_rejects")
def c15(spark, sf):
    return _raw_import(spark, sf)[1]


@query("c20_import_summary")
def c20(spark, sf):
    """The counts of the import, and its error messages, every one a row."""
    p = prog(spark, sf)
    accepted, rejected = _raw_import(spark, sf, materialize=True)
    target = p.participants.select("email", "name", "phone_number", "registration_date_time")
    res = M.merge_keyed(target, accepted.select("email", "name", "phone_number", "registration_date_time",
                                                "row_number"),
                        ["email"], "upsert", run_ts=RUN_TS, touch_col=None, created_col=None,
                        insert_defaults_ts=("registration_date_time",))
    batch_rows = p.raw_rows
    return IM.import_report(batch_rows, res.outcome, rejected)


@query("c20_summary_by_file")
def c20_by_file(spark, sf):
    """Raw rows dealt over seven files of three sheets, summarised per file and sheet."""
    k = F.col("row_number_in_file")
    batch = prog(spark, sf).raw_rows.select(
        F.concat(F.lit("file"), (k % 7).cast("string"), F.lit(".csv")).alias("path"), (k % 3).cast("int").alias("sheet_index"),
        k.alias("row_number"), "email", "name", F.col("phone").alias("phone_number"))
    return IM.file_summary(batch, "participants", {f: f for f in ("email", "name", "phone_number")}, SLOT_YEAR)


def _booking_import(spark, sf):
    """Raw rows over seven files of three sheets as bookings of one workshop: many e-mails repeat, some names are too
    wide, and only participants of an earlier cohort are known."""
    p = prog(spark, sf)
    k = F.col("row_number_in_file")
    batch = p.raw_rows.select(
        F.concat(F.lit("file"), (k % 7).cast("string"), F.lit(".csv")).alias("path"), (k % 3).cast("int").alias("sheet_index"),
        k.alias("row_number"), "email", F.when(k % 11 == 0, F.repeat(F.trim("name"), F.lit(20))).otherwise(F.col("name")).alias("name"))
    return AD.import_batch(batch, "bookings", {"email": "email", "name": "name"}, p.bookings, SLOT_YEAR, RUN_TS,
                           parent=p.participants.filter("prior_cohort"), constants={"form_name": "Workshop 1"}, touch_col=None)


@query("c20_outcomes_by_file")
def c20_outcomes(spark, sf):
    return _booking_import(spark, sf).summary()


@query("c_import_constraint_rejects")
def import_rejects(spark, sf):
    return _booking_import(spark, sf).rejected


@query("c20_import_state")
def c20_state(spark, sf):
    return _booking_import(spark, sf).merged.state


@query("c21_workbook_summary")
def c21(spark, sf):
    """Bookings re-sent from the lab records, each second one twice, one sheet per workshop: rows, inserts, updates and
    workshops per sheet and in total, counted by record."""
    p = prog(spark, sf)
    sent = booking_batch(p)
    again = sent.filter(F.length("email") % 2 == 0).withColumn("row_number", F.col("row_number") + F.expr("INTERVAL 400 DAYS"))
    records = sent.unionByName(again).withColumn("sheet_index", F.substring("form_name", 10, 3).try_cast("int"))
    fates = AD.record_outcomes(records, p.bookings, ["email", "form_name"], "upsert", "row_number")
    return IM.workbook_summary(AD.sheet_outcomes(fates, "form_name"))


@query("u5_weekly_update_mode")
def u5(spark, sf):
    """Weekly update mode: per (week, e-mail) the latest event supplies
    a repository link and likes; only non-null fields overwrite, updated_at
    takes the supplied time, else the run time."""
    p = prog(spark, sf)
    target = p.weekly.withColumn("updated_at", F.col("created_at"))
    e = Tables(spark, sf).events
    eid = F.col("event_id")
    sup = e.select((F.floor((F.dayofmonth("ts") - 1) / 7).cast("int") + 1).alias("week_number"),
                   F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
                   F.when(eid % 2 == 0, F.concat(F.lit("https://github.com/upd/"), eid.cast("string"))).alias("gl"),
                   F.when(eid % 3 == 0, (eid % 7).cast("int")).alias("lk"),
                   F.when(eid % 5 != 0, F.col("ts")).alias("ua"), eid.alias("row_number"))
    updates = M.reduce_batch(sup, ["week_number", "email"], "row_number").select(
        "week_number", "email", F.col("gl").alias("github_link"), F.col("lk").alias("likes"),
        F.col("ua").alias("updated_at"))
    state, _ = M.partial_update(target, updates, ["week_number", "email"], run_ts=RUN_TS, touch_from="updated_at")
    return state


def booking_batch(p):
    """Bookings re-sent from the lab records: slot from the assignment time,
    slot text from the problem statement, file order = creation time (one
    record per key, so ties cannot occur)."""
    return p.labs.select("email", F.col("workshop_name").alias("form_name"), "name",
                         F.col("assigned_at").alias("time_slot"), F.col("problem_statement").alias("time_slot_range"),
                         F.col("created_at").alias("row_number"))


@query("u7_u14_insert_or_replace_bookings")
def u7(spark, sf):
    p = prog(spark, sf)
    target = p.bookings.withColumn("updated_at", F.col("created_at"))
    return M.merge_keyed(target, booking_batch(p), ["email", "form_name"], "upsert", run_ts=RUN_TS,
                         overwrite=["name", "time_slot", "time_slot_range"]).state


@query("u10_update_by_occupation")
def u10(spark, sf):
    """One-to-many update: a designation per occupation (non-key match) hits
    every participant with that occupation; counted per row hit."""
    p = prog(spark, sf)
    c = Tables(spark, sf).customer.select("c_mktsegment").distinct()
    batch = c.select(F.col("c_mktsegment").alias("occupation"),
                     F.concat(F.lit("Lead of "), F.col("c_mktsegment")).alias("designation"),
                     F.lit(1).cast("long").alias("row_number"))
    res = M.merge_on_match_fields(p.participants.select("email", "occupation", "designation"), batch,
                                  ["occupation"], "update", run_ts=RUN_TS, target_key=["email"])
    return res.state


@query("u10_update_by_occupation_count")
def u10_count(spark, sf):
    p = prog(spark, sf)
    c = Tables(spark, sf).customer.select("c_mktsegment").distinct()
    batch = c.select(F.col("c_mktsegment").alias("occupation"),
                     F.concat(F.lit("Lead of "), F.col("c_mktsegment")).alias("designation"),
                     F.lit(1).cast("long").alias("row_number"))
    res = M.merge_on_match_fields(p.participants.select("email", "occupation", "designation"), batch,
                                  ["occupation"], "update", run_ts=RUN_TS, target_key=["email"])
    return res.counts()
