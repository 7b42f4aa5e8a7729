"""Registered link-validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import links as LK
from rollcall.operators import validation as V
from rollcall.plans.catalog import prog, query

# Fixture bindings: the blog domain of the submissions is the allowed one,
# and fetched pages are the linked pages addressed by their id.
FIXTURE_DOMAINS = ["blog.example.org"]
FIXTURE_MARKER = ".marker"


def fetched_pages(p):
    lp = p.linked_pages
    return lp.select(F.concat(F.lit("https://blog.example.org/p/"), F.col("page_id").cast("string")).alias("link"),
                     "html", F.lit(200).alias("status"))


def _verdicts(p):
    return V.link_verdicts(p.submissions, fetched_pages(p), domains=FIXTURE_DOMAINS)


def mixed_fetches(p):
    """The linked pages under the weekly entries' blog links, fetched with status 200, 404 or 500, or with an error
    text, by page id; some hold a run of digits that no number type holds."""
    pid = F.col("page_id")
    return p.linked_pages.select(
        F.concat(F.lit("https://blog.example.org/w/"), pid.cast("string")).alias("link"),
        F.when(pid % 7 == 3, F.concat(F.lit('<button aria-label="Like this article"><span>123456789012345678901</span></button>'),
                                      F.col("html"))).otherwise(F.col("html")).alias("html"),
        F.when(pid % 5 == 1, 500).when(pid % 11 == 2, 404).otherwise(200).alias("status"),
        F.when(pid % 13 == 4, "Request timeout").alias("error"))


@query("v4_weekly_link_verdicts")
def v4_weekly(spark, sf):
    p = prog(spark, sf)
    return V.link_verdicts(p.weekly, mixed_fetches(p), "blog_link", FIXTURE_DOMAINS)


@query("v5_weekly_refreshed")
def v5_weekly(spark, sf):
    p = prog(spark, sf)
    verdicts = V.link_verdicts(p.weekly, mixed_fetches(p), "blog_link", FIXTURE_DOMAINS)
    return V.refresh_submissions(p.weekly, verdicts, ("week_number", "email")).select(
        "week_number", "email", "valid", "likes", "comments", "validation_reason")


def repo_fetches(p):
    """One fetch result per listed repository, with a status by the repository's first event."""
    first = F.min(F.col("event_id"))
    e = p.tables.events
    repo = F.concat(F.lit("https://github.com/user"), F.col("user_id").cast("string"), F.lit("/repo"),
                    (F.col("event_id") % 50).cast("string"))
    k = F.col("k") % 9
    return e.groupBy(repo.alias("repo_url")).agg(first.alias("k")).select(
        "repo_url",
        F.when(k == 1, 404).when(k == 2, 429).when(k.isin(3, 4), 403).when(k == 5, 500).otherwise(200).alias("status"),
        F.when(k == 5, "server error").alias("message"), F.when(k == 3, 0).alias("remaining"))


@query("v8_repo_status_verdicts")
def v8(spark, sf):
    p = prog(spark, sf)
    return V.repo_verdicts(p.weekly, p.repo_entries, marker_prefix=FIXTURE_MARKER, fetches=repo_fetches(p))


@query("v5_weekly_repositories")
def v5_repositories(spark, sf):
    p = prog(spark, sf)
    verdicts = V.repo_verdicts(p.weekly, p.repo_entries, marker_prefix=FIXTURE_MARKER, fetches=repo_fetches(p))
    return V.refresh_repositories(p.weekly, verdicts).select("week_number", "email", "github_valid",
                                                             "github_validation_reason")


@query("v1_v3_page_signals")
def v1_v3(spark, sf):
    p = prog(spark, sf)
    return V.page_signals(fetched_pages(p)).select(
        "link", "missing", "page_likes", "page_comments",
        LK.allowed_domain(F.col("link"), FIXTURE_DOMAINS).alias("allowed"))


@query("v2_missing_page_rendered")
def v2(spark, sf):
    lp = prog(spark, sf).linked_pages
    return lp.select("page_id", LK.missing_page_rendered(F.col("html")).alias("missing"),
                     LK.counter(F.col("html"), LK.LIKE_LABEL, rendered=True).alias("likes"),
                     LK.counter(F.col("html"), LK.COMMENT_LABEL, rendered=True).alias("comments"))


@query("v2_missing_page_reference_window")
def v2_window(spark, sf):
    """The source system's judgement, which looks at the first 1000 (text) and 2000 (source) characters; all other
    queries judge whole pages."""
    lp = prog(spark, sf).linked_pages
    return lp.select("page_id", LK.missing_page_plain(F.col("html"), window=LK.PLAIN_TEXT_WINDOW).alias("plain"),
                     LK.missing_page_rendered(F.col("html"), LK.RENDERED_SOURCE_WINDOW).alias("rendered"))


@query("v4_link_verdicts")
def v4(spark, sf):
    return _verdicts(prog(spark, sf))


@query("v5_refreshed_submissions")
def v5(spark, sf):
    p = prog(spark, sf)
    return V.refresh_submissions(p.submissions, _verdicts(p))


@query("v6_repo_url_parts")
def v6(spark, sf):
    w = prog(spark, sf).weekly.filter(F.col("github_link").isNotNull() & (F.col("github_link") != ""))
    parts = LK.repo_path_parts(F.col("github_link"))
    return w.select("week_number", "email", F.try_element_at(parts, F.lit(1)).alias("owner"),
                    F.try_element_at(parts, F.lit(2)).alias("repo"))


@query("v7_marker_folder_check")
def v7(spark, sf):
    p = prog(spark, sf)
    return V.repo_verdicts(p.weekly, p.repo_entries, marker_prefix=FIXTURE_MARKER)


@query("v9_run_totals")
def v9(spark, sf):
    return V.run_totals(_verdicts(prog(spark, sf)))


@query("v10_progress_trail")
def v10(spark, sf):
    return V.progress_trail(_verdicts(prog(spark, sf)), ["workshop_name", "email"])


@query("v11_pattern_counters")
def v11(spark, sf):
    lp = prog(spark, sf).linked_pages
    return lp.select("page_id", LK.pattern_counter(F.col("html"), LK.LIKE_PATTERN).alias("likes"),
                     LK.pattern_counter(F.col("html"), LK.COMMENT_PATTERN).alias("comments"))
