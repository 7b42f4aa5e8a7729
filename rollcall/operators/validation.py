"""Bulk link validation as joins over fetched-page and listing tables
(V4-V10).

The reference validates one link per thread against the live web.  Here the
fetch results are tables: ``pages`` (link, status, html) and ``entries``
(repo_url, entry_name, entry_type).  Each page is scanned once (signals per
distinct link), and the narrow signals are joined back to the submissions,
so a link shared by many submissions is parsed once and a hot link only
moves a few columns through the skew-aware join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import links as LK
from rollcall.session import ensure_checkpoint_dir

NOT_FETCHED = "Page not fetched"
SPREAD = 1024       # key values over which rows without a join key are dealt

# Verdict and progress texts of the link and repository checks.
REASON_VERIFIED = "Verified"
REASON_VERIFIED_BUT = "Verified but "
REASON_MISSING_PAGE = "404 Not Found"
REASON_INVALID_DOMAIN = "Invalid Domain"
REQUEST_ERROR = "Request error: "
PROGRESS_UPDATED = "Processed %d/%d: %s... (Likes: %d, Comments: %d)"
PROGRESS_OTHER = "Processed %d/%d: %s... (%s)"
REPO_BAD_FORMAT = "Invalid GitHub URL format. Expected owner/repo, got: "
REPO_NOT_FOUND = "Repository not found (404)"
REPO_NOT_FOUND_MESSAGE = "Repository not found: "
REPO_FOUND = "Valid - Found folder: "
REPO_NO_MARKER = "Invalid - No folder starting with '{prefix}' found. Available folders: "
REPO_NO_FOLDERS = "Invalid - No folders found in repository root"
REPO_RATE_LIMITED = "Rate limit exceeded. Please wait and try again later"
REPO_RATE_LIMITED_SHORT = "Rate limit exceeded."
REPO_FORBIDDEN = "Repository access forbidden (may be private)"
REPO_API_ERROR = "GitHub API error: "


def page_signals(pages: DataFrame, link_col: str = "link", html_col: str = "html",
                 status_col: str | None = "status", error_col: str | None = "error",
                 plain_window: int | None = None, rendered_window: int | None = None) -> DataFrame:
    """V2 + V3 per fetched page: missing flag, the two counters and the fetch
    error, choosing the rendered or plain reading from the link's domain.

    A page whose ``error_col`` holds a text, or whose status is 400 or above
    (404 means missing), was not read: its error is that text, else
    ``Request error: <status>``.  ``plain_window`` / ``rendered_window`` limit
    the missing-page test to the first characters; by default it reads whole
    pages."""
    link, html = F.col(link_col), F.col(html_col)
    rendered = LK.allowed_domain(link, LK.RENDERED_DOMAINS)
    status = F.col(status_col) if status_col and status_col in pages.columns else None
    text = F.col(error_col) if error_col and error_col in pages.columns else F.lit(None).cast("string")
    error = F.when(text != "", text)
    if status is not None:
        error = F.coalesce(error, F.when((status >= 400) & (status != 404),
                                         F.concat(F.lit(REQUEST_ERROR), status.cast("string"))))
    found = F.when(rendered, LK.missing_page_rendered(html, rendered_window)) \
        .otherwise(LK.missing_page_plain(html, status, plain_window))
    return pages.select(
        link.alias("link"),
        (error.isNull() & found).alias("missing"),
        F.when(rendered, LK.counter(html, LK.LIKE_LABEL, True)).otherwise(LK.counter(html, LK.LIKE_LABEL))
        .alias("page_likes"),
        F.when(rendered, LK.counter(html, LK.COMMENT_LABEL, True)).otherwise(LK.counter(html, LK.COMMENT_LABEL))
        .alias("page_comments"),
        error.alias("page_error"),
    )


def reduced_signals(signals: DataFrame) -> DataFrame:
    """One row per link: a page that was read comes before one that failed."""
    return (signals.groupBy("link")
            .agg(F.min(F.struct(F.col("page_error").isNotNull().alias("failed"), "missing", "page_likes", "page_comments",
                                "page_error")).alias("s"))
            .select("link", "s.missing", "s.page_likes", "s.page_comments", "s.page_error", F.lit(True).alias("__fetched")))


def link_verdicts(submissions: DataFrame, pages: DataFrame | None = None, link_col: str = "project_link",
                  domains: list[str] = LK.ALLOWED_DOMAINS, keys: tuple[str, ...] = ("workshop_name", "week_number", "email"),
                  signals: DataFrame | None = None, **windows) -> DataFrame:
    """V4: one verdict per submission with a non-empty link:
    not allowed -> (false, Invalid Domain, 0, 0); missing page ->
    (false, 404 Not Found, 0, 0); page not fetched, or fetched with an error
    -> (true, Verified but <error>, 0, 0); else (true, Verified, likes,
    comments).

    ``keys`` (those that the table has) identify the entry, so blog links of
    weekly entries can be written back like submissions.  One join: a link on
    an allowed domain is its own key, all others are dealt over ``SPREAD``
    keys that no link equals.  ``signals`` takes signals that were reduced
    before (a stream derives them once)."""
    subs = submissions.filter(F.col(link_col).isNotNull() & (F.col(link_col) != ""))
    keep = [c for c in submissions.columns if c in keys]
    sig = signals if signals is not None else reduced_signals(page_signals(pages, **windows))
    ok = LK.allowed_domain(F.col(link_col), domains)
    nowhere = F.concat(F.lit("\x00"), F.pmod(F.hash(*(keep or [link_col])), F.lit(SPREAD)).cast("string"))
    j = subs.select(*keep, F.col(link_col).alias("__l"), ok.alias("__ok"),
                    F.when(ok, F.col(link_col)).otherwise(nowhere).alias("link")).join(sig, "link", "left")
    fetched = F.col("__fetched").isNotNull()
    missing = fetched & F.col("missing")
    error = F.when(~fetched, F.lit(NOT_FETCHED)).otherwise(F.col("page_error"))
    read = F.col("__ok") & fetched & ~F.col("missing") & F.col("page_error").isNull()
    return j.select(
        *keep, F.col("__l").alias("link"),
        (F.col("__ok") & ~missing).alias("valid"),
        F.when(~F.col("__ok"), F.lit(REASON_INVALID_DOMAIN)).when(missing, F.lit(REASON_MISSING_PAGE))
        .when(error.isNotNull(), F.concat(F.lit(REASON_VERIFIED_BUT), error)).otherwise(REASON_VERIFIED).alias("reason"),
        F.when(read, F.col("page_likes")).otherwise(0).cast("int").alias("likes"),
        F.when(read, F.col("page_comments")).otherwise(0).cast("int").alias("comments"))


def refresh_submissions(submissions: DataFrame, verdicts: DataFrame,
                        keys: tuple[str, ...] = ("workshop_name", "email")) -> DataFrame:
    """V5: write each verdict back to its submission (valid, reason, likes,
    comments), even when the row was valid already; rows without a link keep
    their values."""
    v = verdicts.select(*keys, F.col("valid").alias("__v"), F.col("reason").alias("__r"),
                        F.col("likes").alias("__l"), F.col("comments").alias("__c"),
                        F.lit(True).alias("__hit"))
    j = submissions.join(v, list(keys), "left")
    hit = F.col("__hit").isNotNull()
    out = []
    for c in submissions.columns:
        if c == "valid":
            out.append(F.when(hit, F.col("__v")).otherwise(F.col(c)).alias(c))
        elif c == "likes":
            out.append(F.when(hit, F.col("__l")).otherwise(F.col(c)).alias(c))
        elif c == "comments":
            out.append(F.when(hit, F.col("__c")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    existing_reason = F.col("validation_reason") if "validation_reason" in submissions.columns else F.lit(None)
    out.append(F.when(hit, F.col("__r")).otherwise(existing_reason).cast("string").alias("validation_reason"))
    return j.select(*out).select(*[c for c in submissions.columns if c != "validation_reason"],
                                 "validation_reason")


def refresh_repositories(weekly: DataFrame, verdicts: DataFrame,
                         keys: tuple[str, ...] = ("week_number", "email")) -> DataFrame:
    """V5 for repositories: write ``github_valid`` and its reason back to the
    weekly entries; entries without a link keep their values."""
    v = verdicts.select(*keys, F.col("github_valid").alias("__v"), F.col("github_validation_reason").alias("__r"),
                        F.lit(True).alias("__hit"))
    j = weekly.join(v, list(keys), "left")
    hit = F.col("__hit").isNotNull()
    old = F.col("github_validation_reason") if "github_validation_reason" in weekly.columns else F.lit(None)
    cols = [F.when(hit, F.col("__v")).otherwise(F.col(c)).alias(c) if c == "github_valid" else F.col(c)
            for c in weekly.columns if c != "github_validation_reason"]
    return j.select(*cols, F.when(hit, F.col("__r")).otherwise(old).cast("string").alias("github_validation_reason"))


def run_totals(verdicts: DataFrame) -> DataFrame:
    """V9: validated, failed, and updated (valid with likes or comments > 0)."""
    return verdicts.agg(
        F.count_if(F.col("valid")).alias("validated"),
        F.count_if(~F.col("valid")).alias("failed"),
        F.count_if(F.col("valid") & ((F.col("likes") > 0) | (F.col("comments") > 0))).alias("updated"),
    )


def progress_trail(verdicts: DataFrame, order: list[str], link_chars: int | None = None, keep: tuple[str, ...] = (),
                   start: dict[str, int] | None = None) -> DataFrame:
    """One progress row per processed item in ``order``: running
    current / validated / failed / updated, total, and a status text (with
    the whole link, or its first ``link_chars`` characters).

    Running sums use a two-level prefix sum, never one global window: items
    are range-partitioned on the order; per-partition totals get a prefix sum
    (a window over #partitions rows) and each partition's own running sums
    are a window partitioned by partition id.  Items that are equal in
    ``order`` follow by their links and verdicts.  ``start`` has the counts
    (total, validated, failed, updated) of items processed before, which all
    counts continue; ``keep`` names further columns of the result.
    The range-partitioned frame is checkpointed once so that both branches
    see the same partition ids."""
    upd = F.col("valid") & ((F.col("likes") > 0) | (F.col("comments") > 0))
    items = verdicts.select("*", F.col("valid").cast("int").alias("__ok"), (~F.col("valid")).cast("int").alias("__bad"),
                            upd.cast("int").alias("__upd"))
    start = start or {}
    ties = [c for c in ("link", "valid", "reason", "likes", "comments") if c not in order]
    keyed = items.withColumn("__k", F.struct(*order, *ties))
    # partition ids are read by two branches below (totals and running sums);
    # AQE may coalesce the range partitions differently in each evaluation,
    # so the numbered frame is checkpointed once (reliable checkpoint in the
    # shared checkpoint folder) and both branches read the same ids
    ensure_checkpoint_dir(verdicts.sparkSession)
    ranged = keyed.repartitionByRange("__k").withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    part_sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"),
                                             F.sum("__ok").alias("__sok"), F.sum("__bad").alias("__sbad"),
                                             F.sum("__upd").alias("__supd"))
    w_parts = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_sizes.select(
        "__part",
        F.coalesce(F.sum("__n").over(w_parts), F.lit(0)).alias("__o_n"),
        F.coalesce(F.sum("__sok").over(w_parts), F.lit(0)).alias("__o_ok"),
        F.coalesce(F.sum("__sbad").over(w_parts), F.lit(0)).alias("__o_bad"),
        F.coalesce(F.sum("__supd").over(w_parts), F.lit(0)).alias("__o_upd"),
        F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("__total"))
    w_in = Window.partitionBy("__part").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*",
                          F.count(F.lit(1)).over(w_in).alias("__l_n"), F.sum("__ok").over(w_in).alias("__l_ok"),
                          F.sum("__bad").over(w_in).alias("__l_bad"), F.sum("__upd").over(w_in).alias("__l_upd"))
    j = local.join(F.broadcast(offsets), "__part")
    def on_from(so_far, name):
        return (so_far + F.lit(start.get(name, 0))).cast("long")

    current = on_from(F.col("__o_n") + F.col("__l_n"), "total")
    total = on_from(F.col("__total"), "total")
    shown = F.substring(F.col("link"), 1, link_chars) if link_chars else F.col("link")
    status = F.when(F.col("valid") & upd,
                    F.format_string(PROGRESS_UPDATED, current, total, shown,
                                    F.col("likes"), F.col("comments"))) \
        .otherwise(F.format_string(PROGRESS_OTHER, current, total, shown, F.col("reason")))
    return j.select(
        *order,
        current.alias("current"), total.alias("total"),
        on_from(F.col("__o_ok") + F.col("__l_ok"), "validated").alias("validated"),
        on_from(F.col("__o_bad") + F.col("__l_bad"), "failed").alias("failed"),
        on_from(F.col("__o_upd") + F.col("__l_upd"), "updated").alias("updated"),
        status.alias("status"), *keep)


# ---------------------------------------------------------------- V6-V8
def repo_verdicts(weekly: DataFrame, entries: DataFrame, link_col: str = "github_link",
                  marker_prefix: str = LK.MARKER_PREFIX, shown: int | None = None,
                  fetches: DataFrame | None = None) -> DataFrame:
    """V6 + V7 + V8, one verdict per entry with a link:

    * bad URL -> (false, Invalid GitHub URL format. Expected owner/repo, got: <url>)
    * a fetch that failed (``fetches``: repo_url, status, message, remaining) ->
      (false, the status text of V8)
    * no listing -> (false, Repository not found (404))
    * a root entry of type dir starting with the marker -> (true, Valid - Found folder: <first>)
    * other dirs -> (false, ... Available folders: <all, or the first ``shown``>)
    * no dirs -> (false, Invalid - No folders found in repository root)

    Listings are reduced to one row per repository in one aggregation.  Bad
    URLs have no repository; they are dealt over ``SPREAD`` keys of their own."""
    sub = weekly.filter(F.col(link_col).isNotNull() & (F.col(link_col) != ""))
    parts = LK.repo_path_parts(F.col(link_col))
    keep = [c for c in weekly.columns if c in ("week_number", "email")]
    sub = sub.select(*keep, F.col(link_col).alias("link"), parts.alias("__parts"),
                     LK.normalized_repo_url(F.col(link_col)).alias("__url"))
    nowhere = F.concat(F.lit("\x00"), F.pmod(F.hash("link", *keep), F.lit(SPREAD)).cast("string"))
    sub = sub.withColumn("__repo", F.when(F.col("__parts").isNotNull(), F.lower(F.concat_ws("/", "__parts")))
                         .otherwise(nowhere))
    e_parts = LK.repo_path_parts(F.col("repo_url"))
    is_dir = F.col("entry_type") == "dir"
    info = (entries.filter(e_parts.isNotNull())
            .select(F.lower(F.concat_ws("/", e_parts)).alias("__repo"), "entry_name", "entry_type")
            .groupBy("__repo")
            .agg(F.lit(True).alias("__listed"),
                 F.min(F.when(is_dir & F.col("entry_name").startswith(marker_prefix), F.col("entry_name"))).alias("__marker"),
                 F.array_sort(F.collect_set(F.when(is_dir, F.col("entry_name")))).alias("__dirs")))
    j = sub.join(info, "__repo", "left")
    failed = F.lit(None).cast("string")
    if fetches is not None:
        f_parts = LK.repo_path_parts(F.col("repo_url"))
        got = (fetches.filter(f_parts.isNotNull())
               .select(F.lower(F.concat_ws("/", f_parts)).alias("__repo"), "status",
                       repo_status_reason("status", "message", "remaining").alias("__failed"))
               .groupBy("__repo").agg(F.min_by("__failed", F.struct("status", "__failed")).alias("__failed")))
        j = j.join(got, "__repo", "left")
        failed = F.col("__failed")
    names = F.coalesce("__dirs", F.array().cast("array<string>"))
    listed = F.slice(names, 1, shown) if shown else names
    good = F.col("__parts").isNotNull() & failed.isNull() & F.col("__listed").isNotNull()
    reason = (F.when(F.col("__parts").isNull(), F.concat(F.lit(REPO_BAD_FORMAT), F.col("__url")))
              .when(failed.isNotNull(), failed)
              .when(F.col("__listed").isNull(), F.lit(REPO_NOT_FOUND))
              .when(F.col("__marker").isNotNull(), F.concat(F.lit(REPO_FOUND), F.col("__marker")))
              .when(F.size(names) > 0, F.concat(F.lit(REPO_NO_MARKER.format(prefix=marker_prefix)),
                                                F.array_join(listed, ", ")))
              .otherwise(F.lit(REPO_NO_FOLDERS)))
    return j.select(*keep, "link", (good & F.col("__marker").isNotNull()).alias("github_valid"),
                    reason.alias("github_validation_reason"))


def repo_status_reason(status, message=None, remaining=None, url=None) -> "F.Column":
    """V8: verdict text for a repository fetch result."""
    s = F.col(status) if isinstance(status, str) else status
    msg = F.col(message) if isinstance(message, str) else (message if message is not None else F.lit(None))
    rem = F.col(remaining) if isinstance(remaining, str) else (remaining if remaining is not None else F.lit(None))
    return (F.when(s == 200, F.lit(None).cast("string"))
            .when(s == 429, F.lit(REPO_RATE_LIMITED))
            .when(s == 404, F.when(msg.isNotNull(), F.concat(F.lit(REPO_NOT_FOUND_MESSAGE), msg))
                  .otherwise(F.lit(REPO_NOT_FOUND)))
            .when((s == 403) & (F.coalesce(rem.cast("string"), F.lit("")) == "0"), F.lit(REPO_RATE_LIMITED_SHORT))
            .when(s == 403, F.lit(REPO_FORBIDDEN))
            .otherwise(F.concat(F.lit(REPO_API_ERROR), s.cast("string"),
                                F.coalesce(F.concat(F.lit(" - "), msg), F.lit("")))))
