"""Registered search (Q), access (P) and log (L3-L8) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import access as P
from rollcall.operators import changelog as LG
from rollcall.operators import search as S
from rollcall.operators.ordering import with_position
from rollcall.plans.catalog import prog, query
from rollcall.session import Tables

SEARCH_TERM_PARTICIPANT = " USER12 "
SEARCH_TERM_SUBMISSION = " Blog.Example "
SEARCH_TERM_LAB = "rework"
ACCESS_USER = 7
LOG_START, LOG_END = "2024-01-03 00:00:00", "2024-01-05 12:00:00"
LOG_RECORD = "user42@example.com"


def access_requests(spark, sf):
    """A batch of (user, route) access requests, one per line item: the route
    of the delivered part for odd line numbers, that of a later part (granted
    to others, or beyond the catalog) for even ones."""
    li = Tables(spark, sf).lineitem
    route = F.col("l_partkey") + F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).otherwise(0)
    return li.select(F.col("l_suppkey").alias("user_id"),
                     F.concat(F.lit("route_"), route.cast("string")).alias("route_name")).distinct()


@query("q1_participant_search")
def q1_participants(spark, sf):
    return S.search(prog(spark, sf).participants, S.PARTICIPANT_SEARCH_COLUMNS, SEARCH_TERM_PARTICIPANT)


@query("q1_submission_search")
def q1_submissions(spark, sf):
    return S.search(prog(spark, sf).submissions, S.SUBMISSION_SEARCH_COLUMNS, SEARCH_TERM_SUBMISSION)


@query("q1_lab_search")
def q1_labs(spark, sf):
    return S.search(prog(spark, sf).labs, S.LAB_SEARCH_COLUMNS, SEARCH_TERM_LAB, trim=False)


INDEX_GROUP_ROWS = 500


@query("q1_indexed_participant_search")
def q1_indexed(spark, sf):
    """The participant search over a stored table with a trigram index."""
    from rollcall.sinks import text_index
    from rollcall.sinks.writers import scratch_path
    path = scratch_path(spark, "participant-index")
    text_index.write(prog(spark, sf).participants, path, S.PARTICIPANT_SEARCH_COLUMNS, ["email"], INDEX_GROUP_ROWS)
    return text_index.search(spark, path, SEARCH_TERM_PARTICIPANT)


@query("q2_submission_status_workshop_filter")
def q2(spark, sf):
    return S.filter_submissions(prog(spark, sf).submissions, None, "invalid", "workshop 2")


@query("q3_submission_sort_likes_desc")
def q3(spark, sf):
    out = S.dynamic_sort(prog(spark, sf).submissions, "likes", "desc", tiebreak=["workshop_name", "email"])
    return out.select("workshop_name", "email", "likes")


@query("q3_submission_text_sort_positions")
def q3_text(spark, sf):
    """Place of every submission in the listing sorted by workshop, then e-mail."""
    order = [S.sort_key("workshop_name"), S.sort_key("email")]
    return with_position(prog(spark, sf).submissions, order, "position").select("workshop_name", "email", "position")


@query("q4_workshop_facets")
def q4(spark, sf):
    return S.workshop_facets(prog(spark, sf).submissions)


@query("q5_search_result_count")
def q5(spark, sf):
    return S.result_count(prog(spark, sf).submissions,
                          S.search_predicate(S.SUBMISSION_SEARCH_COLUMNS, SEARCH_TERM_SUBMISSION)
                          & S.status_workshop_predicate("valid", "all"))


@query("q6_newest_first_labs")
def q6(spark, sf):
    return S.newest_first(prog(spark, sf).labs).select("workshop_name", "email", "created_at")


@query("p1_effective_permissions")
def p1(spark, sf):
    p = prog(spark, sf)
    return P.effective_permissions(p.access_grants, p.access_permissions)


@query("p2_effective_routes")
def p2(spark, sf):
    p = prog(spark, sf)
    return P.effective_routes(p.access_users, p.access_grants, p.access_permissions)


@query("p3_access_check")
def p3(spark, sf):
    p = prog(spark, sf)
    return P.access_check(access_requests(spark, sf), p.access_users, p.access_grants, p.access_permissions)


@query("p4_grants_by_category")
def p4(spark, sf):
    p = prog(spark, sf)
    return P.grants_by_category(ACCESS_USER, p.access_grants, p.access_permissions)


@query("l3_log_page")
def l3(spark, sf):
    return LG.log_page(prog(spark, sf).change_log, 100, 50)


LOG_BATCHES, LOG_RUN_ROWS = 4, 500


def stored_log(spark, sf):
    """The change log appended in four batches: three by id, and late rows of the first days."""
    from rollcall.sinks import log_runs
    from rollcall.sinks.writers import scratch_path
    path, log = scratch_path(spark, "change-log"), prog(spark, sf).change_log
    n = log.agg(F.max("log_id")).first()[0] or 0
    late = (F.col("log_id") % 101 == 7) & (F.col("log_id") < n / 8)
    for b in range(LOG_BATCHES - 1):
        log_runs.append(log.filter(~late & (F.floor(F.col("log_id") * (LOG_BATCHES - 1) / (n + 1)) == b)), path, f"day-{b}", LOG_RUN_ROWS)
    log_runs.append(log.filter(late), path, "late", LOG_RUN_ROWS)
    return path


@query("l3_deep_page_stored_log")
def l3_deep(spark, sf):
    from rollcall.sinks import log_runs
    return log_runs.page(spark, stored_log(spark, sf), 100, 700)


@query("l5_stored_log_by_operation")
def l5_stored(spark, sf):
    from rollcall.sinks import log_runs
    return log_runs.page(spark, stored_log(spark, sf), 100, 50, operation="DELETE")


@query("l6_stored_log_by_time")
def l6_stored(spark, sf):
    from rollcall.sinks import log_runs
    return log_runs.page(spark, stored_log(spark, sf), 100, start=LOG_START, end=LOG_END)


@query("l4_log_by_table")
def l4(spark, sf):
    return LG.log_by_table(prog(spark, sf).change_log, "submissions")


@query("l5_log_by_operation")
def l5(spark, sf):
    return LG.log_by_operation(prog(spark, sf).change_log, "DELETE")


@query("l6_log_by_time")
def l6(spark, sf):
    return LG.log_by_time(prog(spark, sf).change_log, LOG_START, LOG_END, 100)


@query("l7_record_history")
def l7(spark, sf):
    return LG.record_history(prog(spark, sf).change_log, "bookings", "user41@example.com")


@query("l8_log_query_dispatch")
def l8(spark, sf):
    # both filters given: the table filter wins
    return LG.log_query(prog(spark, sf).change_log, table="weekly", operation="INSERT", limit=100)
