"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import reports as R
from rollcall.plans.catalog import AS_OF, EXPORT_LIMIT, TOP_LIMIT, WEEK, WORKSHOP, prog, query


@query("a1_entity_totals")
def a1(spark, sf):
    p = prog(spark, sf)
    return R.entity_totals(p.participants, p.bookings, p.submissions, p.weekly)


@query("a2_gender_distribution")
def a2_gender(spark, sf):
    return R.category_distribution(prog(spark, sf).participants, "gender")


@query("a2_state_distribution")
def a2_state(spark, sf):
    return R.category_distribution(prog(spark, sf).participants, "state")


@query("a2_occupation_top20")
def a2_occupation(spark, sf):
    return R.category_distribution(prog(spark, sf).participants, "occupation", 20)


@query("a2_city_top20")
def a2_city(spark, sf):
    return R.category_distribution(prog(spark, sf).participants, "city", 20)


@query("a2_designation_top15")
def a2_designation(spark, sf):
    return R.category_distribution(prog(spark, sf).participants, "designation", 15)


@query("a3_age_bands")
def a3(spark, sf):
    return R.age_band_distribution(prog(spark, sf).participants, AS_OF)


@query("a4_bookings_per_workshop")
def a4(spark, sf):
    return R.bookings_per_workshop(prog(spark, sf).bookings)


@query("a5_slot_label")
def a5(spark, sf):
    return R.with_slot_label(prog(spark, sf).bookings).select("email", "form_name", "time_slot_label")


@query("a6_slot_distribution_top15")
def a6(spark, sf):
    return R.slot_distribution(prog(spark, sf).bookings, 15)


@query("a7_registration_trend")
def a7(spark, sf):
    return R.registration_trend(prog(spark, sf).participants, 60)


@query("a8_workshop_slot_occupation")
def a8(spark, sf):
    p = prog(spark, sf)
    return R.workshop_slot_occupation(p.bookings, p.participants)


@query("a9_validity_per_workshop")
def a9(spark, sf):
    return R.validity_stats(prog(spark, sf).submissions)


@query("a10_validity_with_total")
def a10(spark, sf):
    return R.validity_with_total(prog(spark, sf).submissions)


@query("a11_weekly_link_stats")
def a11(spark, sf):
    return R.weekly_link_stats(prog(spark, sf).weekly, WEEK)


@query("a12_challenge_overview")
def a12(spark, sf):
    return R.challenge_overview(prog(spark, sf).weekly)


@query("a13_week_by_week")
def a13(spark, sf):
    return R.week_by_week(prog(spark, sf).weekly)


@query("a14_top_participants")
def a14(spark, sf):
    p = prog(spark, sf)
    return R.top_participants(p.weekly, p.participants, WEEK, TOP_LIMIT).select(
        "week_number", "email", "github_link", "blog_link", "valid", "likes", "comments", "github_valid",
        "created_at", "total_engagement", "name", "phone_number", "country", "state", "city", "gender",
        "designation", "occupation", "date_of_birth", "participated_in_academy_1_0", "registration_date_time")


@query("a15_ranked_engagement_export")
def a15(spark, sf):
    p = prog(spark, sf)
    return R.ranked_engagement_export(p.weekly, p.participants, WEEK, EXPORT_LIMIT)


@query("a16_slot_number_report")
def a16(spark, sf):
    p = prog(spark, sf)
    return R.slot_number_report(p.bookings, p.participants)


@query("a17_workshop_detail")
def a17(spark, sf):
    p = prog(spark, sf)
    return R.workshop_detail(p.bookings, p.participants, WORKSHOP)


@query("a18_slot_listing")
def a18(spark, sf):
    p = prog(spark, sf)
    return R.slot_listing(R.workshop_detail(p.bookings, p.participants, WORKSHOP)).select(
        "slot", "email", "name", "time_slot", "time_slot_range", "created_at", "occupation")


@query("a19_slot_occupation_breakdown")
def a19(spark, sf):
    p = prog(spark, sf)
    return R.slot_occupation_breakdown(R.workshop_detail(p.bookings, p.participants, WORKSHOP))


@query("a20_slot_order")
def a20(spark, sf):
    p = prog(spark, sf)
    return R.slot_order(R.workshop_detail(p.bookings, p.participants, WORKSHOP))


@query("a21_workshop_summary")
def a21(spark, sf):
    return R.workshop_summary(prog(spark, sf).bookings)


@query("a22_weeks_with_submissions")
def a22(spark, sf):
    return R.weeks_with_submissions(prog(spark, sf).weekly)


@query("a22_week_listing")
def a22_listing(spark, sf):
    p = prog(spark, sf)
    return R.week_listing(p.weekly, p.participants)


@query("a23_weekly_with_names")
def a23(spark, sf):
    p = prog(spark, sf)
    return R.weekly_with_names(p.weekly, p.participants)


@query("a24_lab_listing")
def a24_listing(spark, sf):
    return R.lab_listing(prog(spark, sf).labs, WORKSHOP)


@query("a24_lab_stats")
def a24_stats(spark, sf):
    return R.lab_stats(prog(spark, sf).labs)


@query("a25_participant_summary")
def a25(spark, sf):
    p = prog(spark, sf)
    return R.participant_summary(p.participants, p.bookings, p.submissions, p.weekly, p.change_log)


@query("a25_participant_activity")
def a25_activity(spark, sf):
    p = prog(spark, sf)
    return R.participant_activity(p.participants, p.bookings, p.submissions, p.weekly, p.change_log)


@query("a26_validity_share")
def a26(spark, sf):
    return R.validity_share(R.validity_stats(prog(spark, sf).submissions)).select(
        "workshop_name", "total_count", "valid_count", "invalid_count", F.col("valid_share"), F.col("invalid_share"))
