"""Registered source, sink and streaming queries.

These round-trip data that Spark derives from the driver tables through
files in the session's shared checkpoint folder (``spark.checkpoint.dir``),
so the file operators run on inputs that grow with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from rollcall.operators import reports as R
from rollcall.operators import sheet_parse as SP
from rollcall.plans.catalog import RUN_TS, SLOT_YEAR, WORKSHOP, prog, query
from rollcall.plans.catalog_links import FIXTURE_DOMAINS, fetched_pages
from rollcall.plans.catalog_merge import PARTICIPANT_KEYS, participant_batch
from rollcall.sinks import keyed_table as K
from rollcall.sinks import writers as W
from rollcall.sources.delimited import scan_delimited
from rollcall.streaming import continuous as X

EXPORT_SLOT = "20 Nov, 4:00 - 7:00 PM"


RAW_COLUMNS = ["row_number_in_file", "email", "name", "phone", "created_text", "slot_text", "flag_text",
               "degree_text"]


def _raw_rows_csv(spark, sf):
    """raw_rows written as ';'-separated CSV files with a header each (cell
    whitespace kept), then scanned back."""
    path = W.scratch_path(spark, "raw-rows-csv")
    (prog(spark, sf).raw_rows.write.option("header", "true").option("sep", ";")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return scan_delimited(spark, path)


LAYOUTS = [";", ",", "\t"]
FILES_PER_LAYOUT = 16


def layout_files(spark, sf):
    """Files of three layouts, sixteen of each, every one with a header and its rows by number: ';' with two empty cells
    at the end of even rows; ',' with a line break and delimiters inside a quoted cell and an extra column; tab with the
    first six columns.  Returns their folder."""
    path = W.scratch_path(spark, "raw-rows-layouts")
    raw, k = prog(spark, sf).raw_rows, F.col("row_number_in_file")
    for n, sep in enumerate(LAYOUTS):
        rows = raw.filter(k % 3 == n)
        names = RAW_COLUMNS[:6] if sep == "\t" else [*RAW_COLUMNS, "extra"] if sep == "," else RAW_COLUMNS
        if sep == ",":
            rows = rows.withColumn("name", F.concat(F.lit('"'), F.coalesce("name", F.lit("")), F.lit('\n;;"",;,second"')))
            rows = rows.withColumn("extra", F.concat(F.lit("x"), k.cast("string")))
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
        cells = [F.concat(F.lit('"'), c, F.lit('"')) if name == "slot_text" else c for c, name in zip(cells, names, strict=True)]
        line = F.concat_ws(sep, *cells)
        if sep == ";":
            line = F.when(k % 2 == 0, F.concat(line, F.lit(";;"))).otherwise(line)
        # one file per bucket, whose rows lie together and in order
        rows = rows.select((k % FILES_PER_LAYOUT).alias("bucket"), k.alias("k"), line.alias("value"))
        heads = rows.select("bucket").distinct().select("bucket", F.lit(-1).cast("bigint").alias("k"), F.lit(sep.join(names)).alias("value"))
        (heads.unionByName(rows).repartition(FILES_PER_LAYOUT, "bucket").sortWithinPartitions("bucket", "k").drop("k")
         .write.partitionBy("bucket").text(f"{path}/layout={n}"))
    return path


@query("s1_delimited_scan")
def s1(spark, sf):
    """The data rows of files of three layouts, with their row numbers and the number of their cells."""
    rows = scan_delimited(spark, f"{layout_files(spark, sf)}/*/*").filter(F.col("row_number") > 1)
    return rows.select("row_number", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate([*RAW_COLUMNS, "extra"])],
                       F.size("cells").alias("n_cells"))


# Header texts of a participant file, one per field of the parse.
PARTICIPANT_HEADERS = {
    "email": "Email", "name": "Full Name", "phone_number": "Phone Number", "gender": "Gender", "country": "Country", "state": "State",
    "city": "City", "date_of_birth": "DOB", "designation": "Designation", "class_stream": "Class/Stream",
    "degree_passout_year": "Passout Year", "occupation": "Occupation", "linkedin": "LinkedIn URL",
    "participated_in_academy_1_0": "Participated before", "registration_date_time": "Registration Date"}


@query("c19_participant_sheet_parse")
def c19(spark, sf):
    records, _ = SP.parse_participant_sheets(_raw_rows_csv(spark, sf), SLOT_YEAR, RUN_TS)
    return records.drop("path", "sheet_index", "row_number")


def _participant_cells():
    """Cell texts of the participant file, where they are not the stored values."""
    user = F.regexp_extract("email", r"^user(\d+)@", 1).cast("long")
    return {
        "email": F.concat(F.lit(" "), F.upper("email")), "phone_number": F.concat(F.lit("+"), F.col("phone_number")),
        "date_of_birth": F.date_format("date_of_birth", "yyyy-MM-dd HH:mm"),
        "class_stream": F.concat(F.lit(" Stream "), (user % 5).cast("string")),
        "degree_passout_year": F.when(user % 3 != 0, F.concat(F.lit("B.Tech, "), (2000 + user % 25).cast("string"))),
        "linkedin": F.when(user % 4 != 1, F.concat(F.lit("https://in.example/"), user.cast("string"))),
        "participated_in_academy_1_0": F.when(F.col("prior_cohort"), F.lit("Yes")).otherwise("no"),
        "registration_date_time": F.when(user % 7 != 2, F.date_format("registration_date_time", "yyyy-MM-dd HH:mm"))}


@query("c19_participant_file_all_fields")
def c19_all(spark, sf):
    """All participants written as ';'-separated files with a column for each of the fifteen fields, and parsed back."""
    path = W.scratch_path(spark, "participants-csv")
    cells = _participant_cells()
    (prog(spark, sf).participants.select(*[(cells[f] if f in cells else F.col(f)).alias(h)
                                           for f, h in PARTICIPANT_HEADERS.items()])
     .write.option("header", "true").option("sep", ";").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
    records, _ = SP.parse_participant_sheets(scan_delimited(spark, path), SLOT_YEAR, RUN_TS, prefer_exact=True)
    return records.drop("path", "sheet_index", "row_number")


WORKBOOK_USERS = 60
WORKBOOK_SHEETS = 3


def _workbook_of(key, people):
    """One workbook of a group of participants; the academy cell is a number, a flag or a text, by the user's number."""
    import pandas as pd

    from rollcall.sinks.workbook import xlsx_bytes
    headers = list(PARTICIPANT_HEADERS.values())
    sheets = []
    for sheet in range(WORKBOOK_SHEETS):
        rows = [headers]
        for person in people[people["user"] // 4 % WORKBOOK_SHEETS == sheet].to_dict("records"):
            flag = (2, 0, bool(person["prior_cohort"]), "2")[person["user"] % 4]
            rows.append([flag if h == PARTICIPANT_HEADERS["participated_in_academy_1_0"] else person[h] for h in headers])
        sheets.append((f"People {sheet + 1}", rows))
    return pd.DataFrame({"path": [f"people-{key[0]}.xlsx"], "content": [xlsx_bytes(sheets)]})


@query("s2_participant_workbooks")
def s2_participants(spark, sf):
    """All participants in workbooks of sixty users and three sheets, made by tasks and scanned back with typed cells."""
    from rollcall.sources.workbook import workbook_rows
    path = W.scratch_path(spark, "participant-workbooks")
    user, cells = F.regexp_extract("email", r"^user(\d+)@", 1).cast("long"), _participant_cells()
    people = prog(spark, sf).participants.select(
        F.floor(user / WORKBOOK_USERS).alias("file"), user.alias("user"), "prior_cohort",
        *[(cells[f] if f in cells else F.col(f)).cast("string").alias(h) for f, h in PARTICIPANT_HEADERS.items()])
    people.groupBy("file").applyInPandas(_workbook_of, "path string, content binary").write.parquet(path)
    rows = workbook_rows(spark.read.parquet(path), typed=True, sheet_slots=WORKBOOK_SHEETS)
    records, _ = SP.parse_participant_sheets(rows, SLOT_YEAR, RUN_TS, prefer_exact=True)
    return records.drop("path", "sheet_index", "row_number")


@query("o1_workshop_export_rows")
def o1(spark, sf):
    p = prog(spark, sf)
    return W.workshop_export(p.bookings, p.participants, WORKSHOP, EXPORT_SLOT)


@query("o3_report_grid")
def o3(spark, sf):
    p = prog(spark, sf)
    return W.report_grid(R.slot_number_report(p.bookings, p.participants))


@query("o4_json_lines")
def o4(spark, sf):
    return W.json_lines(R.validity_stats(prog(spark, sf).submissions))


@query("x1_merge_stream")
def x1(spark, sf):
    p = prog(spark, sf)
    base = W.scratch_path(spark, "x1")
    p.participants.write.parquet(os.path.join(base, "seed"))
    table = os.path.join(base, "table")
    K.create(spark.read.parquet(os.path.join(base, "seed")), table, PARTICIPANT_KEYS)
    participant_batch(p).write.parquet(os.path.join(base, "incoming"))
    schema = participant_batch(p).schema
    q = X.merge_stream(spark, os.path.join(base, "incoming"), schema, table, os.path.join(base, "log"),
                       "participants", PARTICIPANT_KEYS, os.path.join(base, "ckpt"), RUN_TS,
                       keep_existing=("registration_date_time",), insert_defaults_ts=("registration_date_time",),
                       defaults={"prior_cohort": F.lit(False)}, touch_col=None, created_col=None)
    q.awaitTermination()
    return K.read(spark, table)


def _submission_stream_input(spark, sf):
    base = W.scratch_path(spark, "subs-stream")
    subs = prog(spark, sf).submissions
    subs.write.parquet(os.path.join(base, "in"))
    return base, subs.schema


@query("x2_validation_totals_stream")
def x2(spark, sf):
    base, schema = _submission_stream_input(spark, sf)
    totals = os.path.join(base, "totals")
    q = X.validation_totals_stream(spark, os.path.join(base, "in"), schema, fetched_pages(prog(spark, sf)), totals,
                                   os.path.join(base, "ckpt"), FIXTURE_DOMAINS)
    q.awaitTermination()
    return W.read_versioned(spark, totals)


@query("x3_progress_sink_lines")
def x3(spark, sf):
    base, schema = _submission_stream_input(spark, sf)
    q = X.progress_sink(spark, os.path.join(base, "in"), schema, fetched_pages(prog(spark, sf)),
                        os.path.join(base, "out"), os.path.join(base, "ckpt"), FIXTURE_DOMAINS)
    q.awaitTermination()
    # one micro-batch (all files available at start): one line per item and one summary line
    line = F.from_json("value", "link string, reason string, status string, current long, total long, validated long, failed long, updated long")
    return spark.read.text(os.path.join(base, "out", "*", "*")).select(line.alias("line")).select("line.*")


WEEKLY_SHEET_HEADERS = ["Timestamp", "Email Address", "GitHub Repository URL", "Blog Post", "Created On"]


@query("c_weekly_sheet_import")
def weekly_import(spark, sf):
    """The weekly-challenge import (S5 sheet names, H4 auto-map, H6, cleaning)
    over sheets laid out from the weekly table: one sheet per week named
    ``<n>.Kiro Week <n> Challenge``; row number = participant number + 2."""
    from rollcall.sources.rows import rows_from_frame
    w = prog(spark, sf).weekly
    week = F.col("week_number").cast("string")
    rows = rows_from_frame(
        w, WEEKLY_SHEET_HEADERS,
        [F.lit(""), F.col("email"), F.col("github_link"), F.col("blog_link"),
         F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")],
        path=F.lit("weekly.xlsx"), sheet_index=F.col("week_number"),
        sheet_name=F.concat(week, F.lit(".Kiro Week "), week, F.lit(" Challenge")),
        row_number=F.regexp_extract("email", r"^user(\d+)@", 1).cast("long") + 2)
    records, _ = SP.parse_weekly_sheets(rows, SLOT_YEAR)
    return records.drop("path", "sheet_index")


LAB_SHEET_HEADERS = ["Email", "Name", "Problem Statement", "Proof Link", "Valid", "Assigned To", "Assigned At",
                     "Remarks"]
LAB_MAPPING = {"email": "Email", "name": "Name", "problem_statement": "Problem Statement",
               "hands_on_lab_proof_link": "Proof Link", "valid": "Valid", "assigned_to": "Assigned To",
               "assigned_at": "Assigned At", "remarks": "Remarks"}


@query("c_lab_sheet_import")
def lab_import(spark, sf):
    """The hands-on lab import over sheets laid out from the lab table (one
    sheet per workshop, named after it): fields mapped by header name (H6),
    validity true only for TRUE, assignment time parsed."""
    from rollcall.operators import headers as H
    from rollcall.sources.rows import materialized_headers, rows_from_frame
    labs = prog(spark, sf).labs
    rows = rows_from_frame(
        labs, LAB_SHEET_HEADERS,
        [F.col("email"), F.col("name"), F.col("problem_statement"), F.col("proof_link"),
         F.when(F.col("valid"), "TRUE").when(~F.col("valid"), "false").otherwise(""), F.col("assigned_to"),
         F.date_format("assigned_at", "yyyy-MM-dd HH:mm:ss"), F.col("remarks")],
        path=F.lit("labs.xlsx"), sheet_index=F.substring("workshop_name", 10, 3).cast("int"),
        sheet_name=F.col("workshop_name"),
        row_number=F.regexp_extract("email", r"^user(\d+)@", 1).cast("long") + 2)
    positions = H.positions_for_names(materialized_headers(rows), LAB_MAPPING)
    records, _ = SP.parse_lab_rows(rows, positions, SLOT_YEAR, F.col("sheet_name"))
    return records.drop("path", "sheet_index")


@query("s2_o3_grid_workbook_roundtrip")
def s2(spark, sf):
    """The slot-number grid written as a workbook (O3, spreadsheet target) and
    read back with the workbook scan (S2): the data rows as text cells."""
    from rollcall.sinks.workbook import write_grid_workbook
    from rollcall.sources.workbook import scan_workbooks
    p = prog(spark, sf)
    grid = W.report_grid(R.slot_number_report(p.bookings, p.participants))
    folder = W.scratch_path(spark, "grid-workbook")
    write_grid_workbook(grid, folder, order=["Workshop Number", "Time Slot Number", "Occupation"])
    rows = scan_workbooks(spark, folder).filter(F.col("row_number") > 1)
    return rows.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(W.GRID_HEADER)])
