"""Registered queries over master workbooks: sheet roles (S4), selection (S6), preview (S7), header checks (H2),
form and project parse (C17, C18); a ranked CSV written and read back (O2); a stored table read by schema (S3).

The workbook rows are laid out from bookings (form sheets) and submissions (project sheets), every row of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators import headers as H
from rollcall.operators import reports as R
from rollcall.operators import sheet_parse as SP
from rollcall.plans.catalog import EXPORT_LIMIT, RUN_TS, SLOT_YEAR, WEEK, prog, query
from rollcall.operators.headers import FORM_HEADERS, PROJECT_HEADERS
from rollcall.session import Tables, ensure_checkpoint_dir, spread
from rollcall.sinks import writers as W
from rollcall.sources import sheets as S
from rollcall.sources.delimited import scan_delimited
from rollcall.sources.rows import rows_from_frame

TS = "yyyy-MM-dd HH:mm:ss"


def _sheet_of(role: str, workshop):
    """Sheet position of a workshop's form or project sheet."""
    out = F.lit(None).cast("int")
    for i, (r, w) in enumerate(S.SHEET_ROLES):
        if r == role:
            out = F.when(workshop == w, F.lit(i)).otherwise(out)
    return out


def _laid_out(df, role: str, headers, cells):
    user = F.regexp_extract("email", r"^user(\d+)@", 1).cast("long")
    index = _sheet_of(role, user % 6 + 1)
    blank = F.lit("")
    return rows_from_frame(
        df, headers, [cells.get(h, blank) for h in headers],
        path=F.concat(F.lit("master_"), (F.floor(user / 6) % 3).cast("string"), F.lit(".xlsx")), sheet_index=index,
        sheet_name=F.concat(F.lit("Sheet"), (index + 1).cast("string")), row_number=user + 2)


def master_rows(p):
    """The rows of the workbooks, laid out and stored once (the parsers read them several times), every sheet over all tasks."""
    user = F.regexp_extract("email", r"^user(\d+)@", 1).cast("long")
    mail = F.when(user % 11 == 0, "").when(user % 13 == 1, "broken").otherwise(F.concat(F.lit(" "), F.upper("email")))
    forms = _laid_out(p.bookings, "form", FORM_HEADERS, {
        "Team Name": F.lit("T"), "Name": F.col("name"), "Email": mail,
        FORM_HEADERS[8]: F.coalesce(F.date_format("time_slot", TS), F.lit("")), "Created At": F.date_format("created_at", TS)})
    projects = _laid_out(p.submissions, "project", PROJECT_HEADERS, {
        "Team Name": F.col("team_id"), "Leader Name": F.col("name"), "Leader Email": F.col("email"),
        PROJECT_HEADERS[7]: F.coalesce("project_link", F.lit("")), "Created At": F.date_format("created_at", TS)})
    ensure_checkpoint_dir(p.spark)
    return S.sheet_roles(spread(forms.unionByName(projects), "path", "row_number").checkpoint(eager=True))


@query("c17_form_sheet_parse")
def c17(spark, sf):
    records, _ = SP.parse_form_sheets(master_rows(prog(spark, sf)), SLOT_YEAR, RUN_TS, prefer_exact=True)
    return records.select("workshop_name", "email", "name", "time_slot", "time_slot_range", "created_at", "updated_at",
                          "row_number", "path")


@query("c17_form_sheet_errors")
def c17_errors(spark, sf):
    _, errors = SP.parse_form_sheets(master_rows(prog(spark, sf)), SLOT_YEAR, RUN_TS, prefer_exact=True)
    return errors


@query("c18_project_sheet_parse")
def c18(spark, sf):
    records, _ = SP.parse_project_sheets(master_rows(prog(spark, sf)), SLOT_YEAR, RUN_TS)
    return records.select("workshop_name", "email", "name", "project_link", "valid", "team_id", "created_at", "row_number",
                          "path")


@query("s4_s6_s7_sheet_preview")
def s7(spark, sf):
    """The first data rows of the form sheets, with the number of rows of each sheet."""
    rows = S.select_sheets(master_rows(prog(spark, sf)), kind="form")
    return S.preview(rows, 5).select("path", "sheet_index", "role", "workshop", "row_number", "total_rows",
                                     F.col("cells")[6].alias("name"))


@query("o2_ranked_csv_roundtrip")
def o2(spark, sf):
    """The ranked export written as CSV and scanned back as text cells."""
    p = prog(spark, sf)
    ranked = R.ranked_engagement_export(p.weekly, p.participants, WEEK, EXPORT_LIMIT)
    path = W.scratch_path(spark, "ranked-csv")
    W.write_csv(ranked, path)
    rows = scan_delimited(spark, path, sep=",").filter(F.col("row_number") > 1)
    return rows.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(ranked.columns)])


@query("s3_table_scan")
def s3(spark, sf):
    """Bookings stored before a column was added, read with the later schema."""
    path = W.scratch_path(spark, "stored-bookings")
    prog(spark, sf).bookings.drop("time_slot_range").write.parquet(path)
    schema = T.StructType([T.StructField("email", T.StringType()), T.StructField("form_name", T.StringType()),
                           T.StructField("time_slot", T.TimestampNTZType()), T.StructField("time_slot_range", T.StringType()),
                           T.StructField("seats", T.IntegerType())])
    return S.scan_table(spark, path, schema)


def form_headers(spark, sf):
    """A form sheet per customer: every one lacks the header at a place of its own (17 places, so some are whole), every
    fifth ends after eight columns.  The header table that the header operators take."""
    k = F.col("c_custkey")
    return Tables(spark, sf).customer.select(
        F.concat(F.lit("form"), k.cast("string"), F.lit(".xlsx")).alias("path"), F.lit(0).alias("sheet_index"), k,
        F.posexplode(F.array(*[F.lit(h) for h in FORM_HEADERS])).alias("position", "header")).filter(
        (F.col("position") != k % 17) & ((k % 5 != 0) | (F.col("position") < 8))).drop("c_custkey")


@query("h2_header_errors")
def h2(spark, sf):
    found = H.validate_headers(form_headers(spark, sf), "form")
    return found.select("path", "sheet_index", "n_columns", F.array_join("errors", "; ").alias("errors"))


LAB_FIELDS = ["email", "name", "problem_statement", "proof_link", "assigned_to", "remarks"]
LAB_HEADERS = ["Email", "E-mail Address", "email_id", "Full Name", "Name", "Problem Statement", "proof link", "Assigned", "Remarks (if any)",
               "Date"]


@query("h5_similar_auto_map")
def h5(spark, sf):
    """The columns that fields are mapped to by similar names, for a sheet per customer with six headers out of ten."""
    k = F.col("c_custkey")
    headers = Tables(spark, sf).customer.select(
        k.cast("string").alias("path"), F.lit(0).alias("sheet_index"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.element_at(
            F.array(*[F.lit(h) for h in LAB_HEADERS]), ((k * 7 + j * (1 + k % 3)) % 10 + 1).cast("int")))).alias("position", "header"))
    return H.auto_map_similar(headers, LAB_FIELDS, lab_variant=True)
