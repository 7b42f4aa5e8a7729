"""Sheet parsers composed from the row shape, header operators and cleaning
(C17 form sheets, C18 project sheets, C19 participant sheets).

Each returns ``(records, errors)``: records typed for the target table with
their ``row_number``; errors as (path, sheet_index, row_number, error) where
sheet-level problems carry a null row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import cleaning as C
from rollcall.operators import headers as H
from rollcall.operators.joins import checked_broadcast
from rollcall.sources.rows import data_rows, materialized_headers, non_blank_cells
from rollcall.functions import messages as MSG

ERRORS_SCHEMA = ["path", "sheet_index", "row_number", "error"]


def _sheet_error(df: DataFrame, msg) -> DataFrame:
    return df.select("path", "sheet_index", F.lit(None).cast("long").alias("row_number"),
                     (F.lit(msg) if isinstance(msg, str) else msg).alias("error"))


def _prepare(rows: DataFrame, kind: str | None, fields: dict[str, list[str]], validate: bool,
             prefer_exact: bool = False):
    hdr = materialized_headers(rows)
    look = H.lookup_columns(hdr, fields, prefer_exact)
    errors = []
    if validate:
        val = H.validate_headers(hdr, kind)
        bad = val.filter(F.size("errors") > 0)
        errors.append(bad.select("path", "sheet_index", F.lit(None).cast("long").alias("row_number"),
                                 F.explode("errors").alias("error")))
        # one row per sheet, cut off here: the planner would else scan all rows for a filter on its few
        look = look.join(val.filter(F.size("errors") == 0).select(*H.SHEET), H.SHEET, "left_semi").checkpoint(eager=True)
    missing_req = look.filter(F.col("email").isNull() | F.col("name").isNull())
    errors.append(_sheet_error(missing_req, MSG.MISSING_COLUMNS_NAME_EMAIL if kind
                               else MSG.MISSING_COLUMNS_EMAIL_NAME))
    look = look.filter(F.col("email").isNotNull() & F.col("name").isNotNull())
    mapped = H.apply_mapping(data_rows(rows).filter(non_blank_cells()), look, list(fields))
    return mapped, errors


def _of_sheet(rows: DataFrame, column: str) -> DataFrame:
    """An attribute of the sheets, from their header rows."""
    heads = rows.filter("row_number = 1").select(*H.SHEET, column).distinct()
    return checked_broadcast(heads, H.SHEETS_BOUND)


def _check_rows(mapped: DataFrame, missing_msg: str) -> tuple[DataFrame, DataFrame]:
    t = mapped.withColumn("email", C.normalize_string("email")).withColumn("name", C.normalize_string("name"))
    reason = (F.when(F.col("email").isNull() | F.col("name").isNull(), F.lit(missing_msg))
              .when(~C.is_valid_email("email"), F.concat(F.lit(MSG.INVALID_EMAIL_FORMAT), F.col("email"))))
    t = t.withColumn("__reason", reason)
    errs = t.filter(F.col("__reason").isNotNull()).select(
        "path", "sheet_index", "row_number",
        MSG.row_error("row_number", F.col("__reason")).alias("error"))
    ok = t.filter(F.col("__reason").isNull()).drop("__reason").withColumn("email", C.normalize_email("email"))
    return ok, errs


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _workshop_name(workshop_names: dict[int, str] | None) -> "F.Column":
    name = F.concat(F.lit(MSG.WORKSHOP_PREFIX), F.col("workshop").cast("string"))
    if workshop_names:
        m = F.create_map(*[x for k, v in workshop_names.items() for x in (F.lit(k), F.lit(v))])
        name = F.coalesce(m[F.col("workshop")], name)
    return name


def parse_form_sheets(rows: DataFrame, year: int, run_ts: str,
                      workshop_names: dict[int, str] | None = None,
                      prefer_exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """C17: bookings from form sheets (rows need ``role``/``workshop`` from
    ``sources.sheets.sheet_roles``).  Slot text parsed to a start time and
    kept as text; created/updated parsed or the run time."""
    rows = rows.filter(F.col("role") == "form")
    mapped, errors = _prepare(rows, "form", H.FORM_FIELDS, validate=True, prefer_exact=prefer_exact)
    mapped = mapped.join(_of_sheet(rows, "workshop"), H.SHEET)
    ok, row_errs = _check_rows(mapped, MSG.MISSING_NAME_OR_EMAIL)
    ok = C.with_datetime(ok, "time_slot", "__slot", year)
    ok = C.with_datetime(ok, "created_at", "__created", year)
    ok = C.with_datetime(ok, "updated_at", "__updated", year)
    ts = F.lit(run_ts).cast("timestamp_ntz")
    records = ok.select(
        _workshop_name(workshop_names).alias("workshop_name"), "email", "name",
        F.col("__slot").alias("time_slot"), C.normalize_string("time_slot").alias("time_slot_range"),
        F.coalesce("__created", ts).alias("created_at"), F.coalesce("__updated", ts).alias("updated_at"),
        C.normalize_string("team_name").alias("team_name"), "row_number", *H.SHEET)
    return records, _union(errors + [row_errs])


def parse_project_sheets(rows: DataFrame, year: int, run_ts: str,
                         workshop_names: dict[int, str] | None = None,
                         prefer_exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Submissions from project sheets; team id = team name, valid=false."""
    rows = rows.filter(F.col("role") == "project")
    mapped, errors = _prepare(rows, "project", H.PROJECT_FIELDS, validate=True, prefer_exact=prefer_exact)
    mapped = mapped.join(_of_sheet(rows, "workshop"), H.SHEET)
    ok, row_errs = _check_rows(mapped, MSG.MISSING_NAME_OR_EMAIL)
    ok = C.with_datetime(ok, "created_at", "__created", year)
    ok = C.with_datetime(ok, "updated_at", "__updated", year)
    ts = F.lit(run_ts).cast("timestamp_ntz")
    records = ok.select(
        _workshop_name(workshop_names).alias("workshop_name"), "email", "name",
        C.normalize_string("project_link").alias("project_link"), F.lit(False).alias("valid"),
        C.normalize_string("team_name").alias("team_id"),
        F.coalesce("__created", ts).alias("created_at"), F.coalesce("__updated", ts).alias("updated_at"),
        "row_number", *H.SHEET)
    return records, _union(errors + [row_errs])


def parse_participant_sheets(rows: DataFrame, year: int, run_ts: str,
                             prefer_exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Participants from every sheet of the workbooks (unioned)."""
    mapped, errors = _prepare(rows, None, H.PARTICIPANT_FIELDS, validate=False, prefer_exact=prefer_exact)
    ok, row_errs = _check_rows(mapped, MSG.MISSING_EMAIL_OR_NAME)
    ok = C.with_datetime(ok, "date_of_birth", "__dob", year)
    ok = C.with_datetime(ok, "registration_date_time", "__reg", year)
    s = C.normalize_string
    academy = "participated_in_academy_1_0"
    academy_kind = F.col("kinds")[academy] if "kinds" in ok.columns else None
    records = ok.select(
        "email", "name",
        F.when(F.coalesce(F.col("phone_number"), F.lit("")) != "", C.normalize_phone("phone_number"))
        .alias("phone_number"),
        s("gender").alias("gender"), s("country").alias("country"), s("state").alias("state"),
        s("city").alias("city"), F.to_date("__dob").alias("date_of_birth"), s("designation").alias("designation"),
        s("class_stream").alias("class_stream"), C.year_from_text("degree_passout_year").alias("degree_passout_year"),
        s("occupation").alias("occupation"), s("linkedin").alias("linkedin"),
        C.coerce_boolean(academy, academy_kind).alias(academy),
        F.coalesce("__reg", F.lit(run_ts).cast("timestamp_ntz")).alias("registration_date_time"),
        "row_number", *H.SHEET)
    return records, _union(errors + [row_errs])


WEEKLY_FIELDS = [f for f, _ in H.WEEKLY_PATTERNS]


def parse_weekly_sheets(rows: DataFrame, year: int, mapping: DataFrame | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """Weekly challenge import: sheets named like ``Kiro Week N Challenge``
    (week taken from the name), columns auto-mapped by the best pattern (H4)
    unless a per-sheet ``mapping`` (path, sheet_index, field, position) is
    given.  Text fields stripped (empty -> null), times parsed; e-mail
    required and validated.  Errors are kept whole (this importer does not
    cap them)."""
    from rollcall.sources.sheets import weekly_sheets
    rows = weekly_sheets(rows)
    if mapping is None:
        mapping = H.auto_map_best_pattern(materialized_headers(rows)).select(*H.SHEET, "field", "position")
    wide = H.pivot_mapping(mapping, WEEKLY_FIELDS)
    mapped = H.apply_mapping(data_rows(rows).filter(non_blank_cells()), wide, WEEKLY_FIELDS)
    mapped = mapped.join(_of_sheet(rows, "week_number"), H.SHEET)
    t = mapped
    for f in ("email", "github_link", "blog_link"):
        t = t.withColumn(f, C.normalize_string(f))
    reason = (F.when(F.col("email").isNull(), F.lit(MSG.MISSING_EMAIL))
              .when(~C.is_valid_email("email"), F.concat(F.lit(MSG.INVALID_EMAIL), F.col("email"))))
    t = t.withColumn("__reason", reason)
    errors = t.filter(F.col("__reason").isNotNull()).select(
        "path", "sheet_index", "row_number",
        MSG.row_error("row_number", F.col("__reason")).alias("error"))
    ok = t.filter(F.col("__reason").isNull()).withColumn("email", C.normalize_email("email"))
    ok = C.with_datetime(ok, "created_at", "__created", year)
    ok = C.with_datetime(ok, "updated_at", "__updated", year)
    records = ok.select("week_number", "email", "github_link", "blog_link",
                        F.col("__created").alias("created_at"), F.col("__updated").alias("updated_at"),
                        "row_number", *H.SHEET)
    return records, errors


def parse_lab_rows(rows: DataFrame, positions: DataFrame, year: int, workshop_name
                   ) -> tuple[DataFrame, DataFrame]:
    """Hands-on lab import: mapped fields (positions per sheet, wide), the
    validity flag true only for the word TRUE, the assignment time parsed,
    e-mail and name required.  ``workshop_name`` is a constant or a column
    (e.g. the sheet name)."""
    fields = ["email", "name", "problem_statement", "hands_on_lab_proof_link", "valid", "assigned_to",
              "assigned_at", "blog_submission", "remarks"]
    present = [f for f in fields if f in positions.columns]
    mapped = H.apply_mapping(data_rows(rows).filter(non_blank_cells()), positions, present)
    for f in fields:
        if f not in present:
            mapped = mapped.withColumn(f, F.lit(None).cast("string"))
    t = mapped
    for f in fields:
        if f not in ("valid", "assigned_at"):
            t = t.withColumn(f, C.normalize_string(f))
    reason = (F.when(F.col("email").isNull() | F.col("name").isNull(), F.lit(MSG.MISSING_EMAIL_OR_NAME))
              .when(~C.is_valid_email("email"), F.concat(F.lit(MSG.INVALID_EMAIL), F.col("email"))))
    t = t.withColumn("__reason", reason)
    errors = t.filter(F.col("__reason").isNotNull()).select(
        "path", "sheet_index", "row_number",
        MSG.row_error("row_number", F.col("__reason")).alias("error"))
    ok = t.filter(F.col("__reason").isNull()).withColumn("email", C.normalize_email("email"))
    ok = C.with_datetime(ok, "assigned_at", "__assigned", year)
    workshop = F.lit(workshop_name) if isinstance(workshop_name, str) else workshop_name
    records = ok.select(workshop.alias("workshop_name"), "email", "name", "problem_statement",
                        "hands_on_lab_proof_link", C.coerce_boolean_upper_true("valid").alias("valid"),
                        "assigned_to", F.col("__assigned").alias("assigned_at"), "blog_submission", "remarks",
                        "row_number", *H.SHEET)
    return records, errors
