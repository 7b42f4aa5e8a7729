"""Dashboard aggregates, breakdowns, top-k and listings.

All operators are DataFrame -> DataFrame.  Aggregations are plain
``groupBy().agg()`` so Spark combines them map-side before the shuffle; a key
holding a third of all rows is therefore reduced per partition first.
Windows only ever run over already-aggregated or limit-bounded frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import labels as L
from rollcall.operators.joins import enrich_bounded, optional_col
from rollcall.operators.ordering import with_position


MAX_RANKED = 1000      # rows of a ranked export

def _count(name: str = "count"):
    return F.count(F.lit(1)).alias(name)


def _count_if(cond, name: str):
    return F.count_if(cond).alias(name)


def _nonempty(c):
    c = L.col_(c)
    return c.isNotNull() & (c != "")


def _is_true(c):
    return F.coalesce(L.col_(c), F.lit(False))


# ---------------------------------------------------------------- A1
def entity_totals(participants: DataFrame, bookings: DataFrame, submissions: DataFrame,
                  weekly: DataFrame) -> DataFrame:
    """Row counts of four tables and the number of distinct weeks, one row.

    The four inputs are tagged and unioned into one narrow frame, so a single
    aggregate answers everything (no joins of one-row frames)."""
    tagged = (
        participants.select(F.lit(0).alias("t"), F.lit(None).cast("int").alias("w"))
        .unionByName(bookings.select(F.lit(1).alias("t"), F.lit(None).cast("int").alias("w")))
        .unionByName(submissions.select(F.lit(2).alias("t"), F.lit(None).cast("int").alias("w")))
        .unionByName(weekly.select(F.lit(3).alias("t"), F.col("week_number").cast("int").alias("w")))
    )
    return tagged.agg(
        _count_if(F.col("t") == 0, "total_participants"),
        _count_if(F.col("t") == 1, "total_bookings"),
        _count_if(F.col("t") == 2, "total_submissions"),
        _count_if(F.col("t") == 3, "total_weekly"),
        F.count_distinct(F.when(F.col("t") == 3, F.col("w"))).alias("total_weeks"),
    )


# ---------------------------------------------------------------- A2
def category_distribution(participants: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """Count per non-empty value of ``column``, most frequent first.

    Ties under the limit are broken by the value so the result is stable."""
    out = (participants.filter(_nonempty(column))
           .groupBy(column).agg(_count())
           .orderBy(F.col("count").desc(), F.col(column).asc()))
    return out.limit(top_n) if top_n else out


# ---------------------------------------------------------------- A3
def age_band_distribution(participants: DataFrame, as_of: str = "2025-06-30") -> DataFrame:
    band = L.age_band("date_of_birth", as_of)
    return (participants.select(band.alias("age_group"))
            .groupBy("age_group").agg(_count())
            .withColumn("band_order", L.age_band_order(F.col("age_group")))
            .orderBy("band_order"))


# ---------------------------------------------------------------- A4
def bookings_per_workshop(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("form_name").agg(_count()).orderBy("form_name")


# ---------------------------------------------------------------- A5 / A6
def with_slot_label(bookings: DataFrame, fmt: str = L.SLOT_FORMAT_MINUTES, name: str = "time_slot_label") -> DataFrame:
    return bookings.withColumn(name, L.slot_label(fmt=fmt))


def slot_distribution(bookings: DataFrame, top_n: int = 15) -> DataFrame:
    return (bookings.select(L.slot_label().alias("slot"))
            .groupBy("slot").agg(_count())
            .orderBy(F.col("count").desc(), F.col("slot").asc())
            .limit(top_n))


# ---------------------------------------------------------------- A7
def registration_trend(participants: DataFrame, days: int = 60) -> DataFrame:
    return (participants.filter(F.col("registration_date_time").isNotNull())
            .select(F.date_format("registration_date_time", "yyyy-MM-dd").alias("date"))
            .groupBy("date").agg(_count())
            .orderBy(F.col("date").desc())
            .limit(days))


# ---------------------------------------------------------------- A8
def workshop_slot_occupation(bookings: DataFrame, participants: DataFrame) -> DataFrame:
    """Bookings of ``Workshop %`` forms by (workshop, slot label, occupation).

    Only the email and occupation of participants travel to the join; the
    join is chosen by Spark (broadcast when the side is small by statistics,
    sort-merge otherwise, AQE may switch at runtime)."""
    b = bookings.filter(F.col("form_name").like("Workshop %")) \
        .select("email", "form_name", L.slot_label().alias("time_slot"))
    p = participants.select("email", "occupation")
    return (b.join(p, "email", "left")
            .groupBy(F.col("form_name").alias("workshop"), "time_slot",
                     L.occupation_label("occupation").alias("occupation"))
            .agg(_count())
            .orderBy("workshop", "time_slot", "occupation"))


# ---------------------------------------------------------------- A9 / A10 / A26
def validity_stats(submissions: DataFrame) -> DataFrame:
    return (submissions.groupBy("workshop_name")
            .agg(_count("total_count"),
                 _count_if(F.col("valid") == True, "valid_count"),  # noqa: E712
                 _count_if(~_is_true("valid"), "invalid_count"))
            .orderBy("workshop_name"))


def validity_with_total(submissions: DataFrame) -> DataFrame:
    """Per-workshop rows plus a grand-total row (``is_total``), one rollup."""
    return (submissions.rollup("workshop_name")
            .agg(_count("total_count"),
                 _count_if(F.col("valid") == True, "valid_count"),  # noqa: E712
                 _count_if(~_is_true("valid"), "invalid_count"),
                 (F.grouping("workshop_name") == 1).alias("is_total"))
            .orderBy("is_total", "workshop_name"))


def validity_share(stats: DataFrame, valid: str = "valid_count", total: str = "total_count",
                   invalid: str = "invalid_count") -> DataFrame:
    """Valid and invalid shares in percent, ``(part / total) * 100`` in that
    order (0 when there are no rows); unrounded, as the progress bars use."""
    def share(part: str):
        return F.when(F.col(total) > 0, (F.col(part) / F.col(total)) * F.lit(100.0)).otherwise(F.lit(0.0))
    return stats.withColumn("valid_share", share(valid)).withColumn("invalid_share", share(invalid))


# ---------------------------------------------------------------- A11-A13
def _link_measures(prefix: str = ""):
    blog = _nonempty("blog_link")
    gh = _nonempty("github_link")
    return [
        _count_if(blog, f"{prefix}blog_count"),
        _count_if(blog & (F.col("valid") == True), f"{prefix}valid_blog_count"),  # noqa: E712
        _count_if(gh, f"{prefix}github_count"),
        _count_if(gh & (F.col("github_valid") == True), f"{prefix}valid_github_count"),  # noqa: E712
    ]


def weekly_link_stats(weekly: DataFrame, week: int) -> DataFrame:
    """Blog and repository link totals for one week, in one pass."""
    blog = _nonempty("blog_link")
    gh = _nonempty("github_link")
    return (weekly.filter(F.col("week_number") == week)
            .agg(_count_if(blog, "blog_total"),
                 _count_if(blog & (F.col("valid") == True), "blog_valid"),  # noqa: E712
                 _count_if(blog & ~_is_true("valid"), "blog_invalid"),
                 _count_if(gh, "github_total"),
                 _count_if(gh & (F.col("github_valid") == True), "github_valid"),  # noqa: E712
                 _count_if(gh & ~_is_true("github_valid"), "github_invalid"))
            .select(F.lit(week).alias("week_number"), "*"))


def challenge_overview(weekly: DataFrame) -> DataFrame:
    return weekly.agg(
        _count("total_submissions"),
        F.count_distinct("week_number").alias("total_weeks"),
        F.count_distinct("email").alias("unique_participants"),
        *_link_measures("total_"),
    ).select("total_submissions", "total_weeks", "unique_participants",
             F.col("total_blog_count").alias("total_blogs"),
             F.col("total_valid_blog_count").alias("valid_blogs"),
             F.col("total_github_count").alias("total_github"),
             F.col("total_valid_github_count").alias("valid_github"))


def week_by_week(weekly: DataFrame) -> DataFrame:
    return (weekly.groupBy("week_number").agg(_count("total_submissions"), *_link_measures())
            .orderBy("week_number"))


# ---------------------------------------------------------------- A14 / A15
PROFILE_COLUMNS = [
    ("name", "string"), ("phone_number", "string"), ("country", "string"), ("state", "string"),
    ("city", "string"), ("linkedin", "string"), ("gender", "string"), ("designation", "string"),
    ("occupation", "string"), ("class_stream", "string"), ("degree_passout_year", "int"),
    ("date_of_birth", "date"), ("participated_in_academy_1_0", "boolean"),
    ("registration_date_time", "timestamp_ntz"),
]


def _profile(participants: DataFrame) -> DataFrame:
    """Participant attributes used by exports; absent columns become typed nulls
    (``prior_cohort`` of the fixture stands for the academy flag)."""
    if "participated_in_academy_1_0" not in participants.columns and "prior_cohort" in participants.columns:
        participants = participants.withColumnRenamed("prior_cohort", "participated_in_academy_1_0")
    return participants.select("email", *[optional_col(participants, c, t) for c, t in PROFILE_COLUMNS])


def top_participants(weekly: DataFrame, participants: DataFrame, week: int, limit: int = 10) -> DataFrame:
    """Most engaged entries of a week with a valid repository link.

    Order: engagement desc, likes desc (nulls first), comments desc (nulls
    first), then email for a stable cut.  The top-k is taken on the weekly
    table first (per-partition top-k then one merge, no full shuffle); only
    the <= ``limit`` winners are then enriched with participant attributes,
    so the join touches a proven-small key set."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    engagement = F.coalesce("likes", F.lit(0)) + F.coalesce("comments", F.lit(0))
    w = (weekly.filter((F.col("week_number") == week) & (F.col("github_valid") == True)  # noqa: E712
                       & (engagement > 0))
         .withColumn("total_engagement", engagement))
    top = w.orderBy(F.col("total_engagement").desc(), F.col("likes").desc_nulls_first(),
                    F.col("comments").desc_nulls_first(), F.col("email").asc()).limit(limit)
    return enrich_bounded(top, _profile(participants), "email", bound=limit)


def ranked_engagement_export(weekly: DataFrame, participants: DataFrame, week: int, limit: int = 10) -> DataFrame:
    """A14 plus rank, engagement, Yes/No flags and formatted dates (25 columns).

    The rank window has no partition key on purpose: it runs over at most
    ``limit`` (at most ``MAX_RANKED``) rows produced by the top-k; a limit
    beyond that is an error."""
    if not 1 <= limit <= MAX_RANKED:
        raise ValueError(f"limit must lie between 1 and {MAX_RANKED}")
    top = top_participants(weekly, participants, week, limit)
    order = Window.orderBy(F.col("total_engagement").desc(), F.col("likes").desc_nulls_first(),
                           F.col("comments").desc_nulls_first(), F.col("email").asc())
    ts_fmt = "yyyy-MM-dd HH:mm:ss"
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    updated = optional_col(top, "updated_at", "timestamp_ntz")
    return top.select(
        F.row_number().over(order).alias("rank"),
        s("email").alias("email"), s("name").alias("name"), s("phone_number").alias("phone_number"),
        s("linkedin").alias("linkedin"), s("country").alias("country"), s("state").alias("state"),
        s("city").alias("city"), s("gender").alias("gender"), s("designation").alias("designation"),
        s("occupation").alias("occupation"), s("class_stream").alias("class_stream"),
        s("degree_passout_year").alias("degree_passout_year"),
        F.coalesce(F.date_format("date_of_birth", "yyyy-MM-dd"), F.lit("")).alias("date_of_birth"),
        L.yes_no("participated_in_academy_1_0").alias("participated_in_academy"),
        F.coalesce(F.date_format("registration_date_time", ts_fmt), F.lit("")).alias("registration_date_time"),
        s("github_link").alias("github_link"), s("blog_link").alias("blog_link"),
        F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("comments", F.lit(0)).alias("comments"),
        F.col("total_engagement"),
        L.yes_no("github_valid").alias("github_valid"), L.yes_no("valid").alias("blog_valid"),
        F.coalesce(F.date_format("created_at", ts_fmt), F.lit("")).alias("created_at"),
        F.coalesce(F.date_format(updated, ts_fmt), F.lit("")).alias("updated_at"),
    )


# ---------------------------------------------------------------- A16 (flagship)
def slot_number_report(bookings: DataFrame, participants: DataFrame) -> DataFrame:
    """Workshop number, slot number, slot label, occupation, count.

    Slot numbers are a dense rank of the slot *date* per workshop (two slots
    on one day share a number).  Text-only slot dates carry no year and sort
    before all real dates; undated slots come last.

    Plan: join bookings to the occupation of participants, aggregate by
    (workshop, sort group, date, label, occupation) - combined map-side - and
    join the rank of the date back.  The window sorts the distinct dates of a
    workshop only; ranking bookings or labels would put a workshop into one
    task."""
    b = (bookings.filter(F.col("form_name").like("Workshop %"))
         .select("email",
                 L.workshop_number("form_name").alias("workshop_number"),
                 L.slot_label().alias("time_slot"),
                 L.slot_sort_group().alias("slot_group"),
                 L.slot_sort_date().alias("slot_date"))
         .filter(F.col("workshop_number").isNotNull()))
    p = participants.select("email", "occupation")
    agg = (b.join(p, "email", "left")
           .groupBy("workshop_number", "slot_group", "slot_date", "time_slot",
                    L.occupation_label("occupation").alias("occupation"))
           .agg(_count()))
    # ranks come from the distinct dates of a workshop, however many labels or bookings there are
    order = Window.partitionBy("workshop_number").orderBy(
        F.col("slot_group").asc_nulls_last(), F.col("slot_date").asc_nulls_last())
    dates = agg.select("workshop_number", "slot_group", "slot_date").distinct()
    ranked = dates.select(F.col("workshop_number").alias("w"), F.col("slot_group").alias("g"), F.col("slot_date").alias("d"),
                          F.row_number().over(order).alias("time_slot_number"))
    return (agg.join(ranked, (F.col("workshop_number") == F.col("w")) & F.col("slot_group").eqNullSafe(F.col("g"))
                     & F.col("slot_date").eqNullSafe(F.col("d")))
            .select("workshop_number", "time_slot_number", "time_slot", "occupation", "count")
            .orderBy("workshop_number", "time_slot_number", "occupation"))


# ---------------------------------------------------------------- A17-A21
def workshop_detail(bookings: DataFrame, participants: DataFrame, workshop: str) -> DataFrame:
    b = bookings.filter(F.col("form_name") == workshop)
    p = participants.select("email", F.col("name").alias("user_name"), "phone_number", "designation",
                            "occupation", optional_col(participants, "linkedin", "string"))
    return (b.join(p, "email", "left")
            .select("email", "form_name", "name", "time_slot", "time_slot_range", "created_at",
                    "user_name", "phone_number", "designation", "occupation", "linkedin")
            .orderBy(F.col("time_slot").asc_nulls_last(), F.col("created_at").asc_nulls_last()))


def slot_listing(detail: DataFrame) -> DataFrame:
    """Rows of a workshop keyed by slot label with seconds (the nested
    grouping of the reference, kept flat: no group is collected into one row)."""
    return (detail.withColumn("slot", L.slot_label(fmt=L.SLOT_FORMAT_SECONDS))
            .withColumn("slot_is_empty", F.col("slot") == L.NO_SLOT)
            .orderBy("slot_is_empty", "slot", F.col("created_at").asc_nulls_last()))


def slot_occupation_breakdown(detail: DataFrame) -> DataFrame:
    """Count per (slot label with seconds, occupation); blank occupation ->
    ``Not Specified``; most frequent first within a slot."""
    return (detail.select(L.slot_label(fmt=L.SLOT_FORMAT_SECONDS).alias("slot"),
                          L.occupation_label("occupation", L.NOT_SPECIFIED).alias("occupation"))
            .groupBy("slot", "occupation").agg(_count())
            .orderBy("slot", F.col("count").desc(), "occupation"))


def slot_occupation_map(breakdown: DataFrame) -> DataFrame:
    """Map variant of A19: slot -> {occupation: count}.  Collects aggregated
    (slot, occupation) pairs only, so each map holds distinct occupations."""
    return breakdown.groupBy("slot").agg(
        F.map_from_entries(F.collect_list(F.struct("occupation", "count"))).alias("occupations"))


def slot_order(detail: DataFrame) -> DataFrame:
    """Distinct slot labels, alphabetical, ``No Time Slot`` last, with their
    positions.  Labels are free text, so they are numbered by tasks."""
    labels = detail.select(L.slot_label(fmt=L.SLOT_FORMAT_SECONDS).alias("slot")).distinct()
    ordered = with_position(labels, [F.col("slot") == L.NO_SLOT, F.col("slot")], "slot_position")
    return ordered.withColumn("slot_position", F.col("slot_position").cast("int"))


def workshop_summary(bookings: DataFrame) -> DataFrame:
    """Responses and distinct slots per form (the header of the detail page,
    computed for every form in one pass)."""
    return (bookings.select("form_name", L.slot_label(fmt=L.SLOT_FORMAT_SECONDS).alias("slot"))
            .groupBy("form_name")
            .agg(_count("total_responses"), F.count_distinct("slot").alias("slot_count"))
            .orderBy("form_name"))


# ---------------------------------------------------------------- A22-A25
def weeks_with_submissions(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("week_number").agg(_count()).orderBy("week_number")


def week_listing(weekly: DataFrame, participants: DataFrame) -> DataFrame:
    p = participants.select("email", "name", "phone_number", "country")
    return (weekly.join(p, "email", "left")
            .orderBy(F.col("week_number").asc(), F.col("created_at").desc()))


def weekly_with_names(weekly: DataFrame, participants: DataFrame) -> DataFrame:
    return (weekly.join(participants.select("email", "name"), "email", "left")
            .orderBy(F.col("week_number").desc(), F.col("created_at").desc()))


def lab_listing(labs: DataFrame, workshop: str) -> DataFrame:
    return labs.filter(F.col("workshop_name") == workshop).orderBy(F.col("created_at").desc())


def lab_stats(labs: DataFrame) -> DataFrame:
    return (labs.groupBy("workshop_name")
            .agg(_count("total_count"),
                 _count_if(F.col("valid") == True, "valid_count"),  # noqa: E712
                 _count_if(~_is_true("valid"), "invalid_count"))
            .orderBy("workshop_name"))


def _children(bookings: DataFrame, submissions: DataFrame, weekly: DataFrame,
              log: DataFrame | None = None) -> DataFrame:
    parts = [
        bookings.select("email", F.lit("booking").alias("kind"), F.col("form_name").alias("item"),
                        F.col("created_at").alias("item_time")),
        submissions.select("email", F.lit("submission").alias("kind"), F.col("workshop_name").alias("item"),
                           F.col("created_at").alias("item_time")),
        weekly.select("email", F.lit("weekly").alias("kind"),
                      F.concat(F.lit("week "), F.col("week_number").cast("string")).alias("item"),
                      F.col("created_at").alias("item_time")),
    ]
    if log is not None:
        parts.append(log.filter(F.col("table_name") == "participants")
                     .select(F.col("record_identifier").alias("email"), F.lit("history").alias("kind"),
                             F.col("operation_type").alias("item"), F.col("log_ts").alias("item_time")))
    children = parts[0]
    for p in parts[1:]:
        children = children.unionByName(p)
    return children


def participant_activity(participants: DataFrame, bookings: DataFrame, submissions: DataFrame,
                         weekly: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Participant 360 in long form: one row per child record, tagged by kind.

    Each participant's children are unioned (no per-participant collection),
    so a participant with a huge history is spread over many tasks."""
    return participants.select("email", "name").join(
        _children(bookings, submissions, weekly, log), "email", "inner")


def participant_summary(participants: DataFrame, bookings: DataFrame, submissions: DataFrame,
                        weekly: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One row per participant with counts of each kind of child record.

    Children are counted per email first (map-side combined), then joined to
    the participants, so no participant's rows are ever gathered together."""
    act = _children(bookings, submissions, weekly, log).groupBy("email").agg(
        _count_if(F.col("kind") == "booking", "bookings"),
        _count_if(F.col("kind") == "submission", "submissions"),
        _count_if(F.col("kind") == "weekly", "weekly_entries"),
        _count_if(F.col("kind") == "history", "history_entries"))
    return (participants.select("email", "name").join(act, "email", "left")
            .select("email", "name",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                      for c in ("bookings", "submissions", "weekly_entries", "history_entries")]))
