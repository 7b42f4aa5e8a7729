"""Oracle SQL (DuckDB dialect) for the master-workbook, ranked-CSV and stored-table queries."""

from __future__ import annotations

from rollcall.operators.headers import FORM_HEADERS
from rollcall.plans.fixture_sql import with_views as W
from rollcall.plans.oracle_reports import ORACLE as _REPORTS

# Sheet position of a workshop's form and project sheet.
POSITIONS = """
place(workshop, form_at, project_at) AS (VALUES (1, 1, 0), (2, 2, 3), (3, 4, 5), (4, 6, 7), (5, 8, 9), (6, 10, 11))"""

FORMS = """
form AS (
  SELECT *, CAST(regexp_extract(email, '^user([0-9]+)@', 1) AS BIGINT) AS u FROM bookings),
sheet AS (
  SELECT f.*, u + 2 AS row_number, 'master_' || CAST((u // 6) % 3 AS VARCHAR) || '.xlsx' AS path, form_at AS sheet_index, workshop,
         CASE WHEN u % 11 = 0 THEN 'none' WHEN u % 13 = 1 THEN 'bad' ELSE 'good' END AS mail
  FROM form f JOIN place ON workshop = u % 6 + 1)"""

RANKED = _REPORTS["a15_ranked_engagement_export"]
RANKED_COLUMNS = [
    "rank", "email", "name", "phone_number", "linkedin", "country", "state", "city", "gender", "designation", "occupation",
    "class_stream", "degree_passout_year", "date_of_birth", "participated_in_academy", "registration_date_time", "github_link",
    "blog_link", "likes", "comments", "total_engagement", "github_valid", "blog_valid", "created_at", "updated_at"]

# The first header that contains "Name" is the team's: the source's lookup, which C18 keeps by default.
ORACLE = {
    "c17_form_sheet_parse": W(f""", {POSITIONS}, {FORMS}
SELECT 'Workshop ' || CAST(workshop AS VARCHAR) AS workshop_name, email, trim(name) AS name, time_slot,
       strftime(time_slot, '%Y-%m-%d %H:%M:%S') AS time_slot_range, date_trunc('second', created_at::TIMESTAMP) AS created_at,
       TIMESTAMP '2025-01-15 09:30:00' AS updated_at, row_number, path
FROM sheet WHERE mail = 'good'""", "bookings"),
    "c17_form_sheet_errors": W(f""", {POSITIONS}, {FORMS}
SELECT path, sheet_index, row_number, 'Row ' || CAST(row_number AS VARCHAR) || ': ' ||
       CASE mail WHEN 'none' THEN 'Missing name or email' ELSE 'Invalid email format: broken' END AS error
FROM sheet WHERE mail <> 'good'""", "bookings"),
    "c18_project_sheet_parse": W(f""", {POSITIONS},
sent AS (SELECT *, CAST(regexp_extract(email, '^user([0-9]+)@', 1) AS BIGINT) AS u FROM submissions)
SELECT 'Workshop ' || CAST(u % 6 + 1 AS VARCHAR) AS workshop_name, email, team_id AS name, nullif(project_link, '') AS project_link,
       false AS valid, team_id, date_trunc('second', created_at::TIMESTAMP) AS created_at, u + 2 AS row_number,
       'master_' || CAST((u // 6) % 3 AS VARCHAR) || '.xlsx' AS path
FROM sent""", "submissions"),
    "s4_s6_s7_sheet_preview": W(f""", {POSITIONS}, {FORMS},
total AS (SELECT path, sheet_index, max(row_number) - 1 AS total_rows FROM sheet GROUP BY ALL)
SELECT path, sheet_index, 'form' AS role, workshop, row_number, total_rows, name
FROM sheet JOIN total USING (path, sheet_index) WHERE row_number BETWEEN 2 AND 6""", "bookings"),
    "o2_ranked_csv_roundtrip": "SELECT " + ", ".join(
        f"ifnull(CAST({c} AS VARCHAR), '') AS {c}" for c in RANKED_COLUMNS) + f" FROM ({RANKED}) ranked",
    "s3_table_scan": W("""
SELECT email, form_name, time_slot, CAST(NULL AS VARCHAR) AS time_slot_range, CAST(NULL AS INTEGER) AS seats
FROM bookings""", "bookings"),
    "h2_header_errors": f"""
WITH named AS (SELECT unnest(range(len(h))) AS position, unnest(h) AS header FROM (SELECT {FORM_HEADERS} AS h)),
seen AS (SELECT c_custkey AS k, header FROM customer, named
         WHERE position <> c_custkey % 17 AND (c_custkey % 5 <> 0 OR position < 8)),
sheet AS (SELECT k, count(*) AS n, bool_or(contains(lower(header), 'email')) AS a, bool_or(contains(lower(header), 'name')) AS b,
                 bool_or(contains(lower(header), 'team name')) AS c FROM seen GROUP BY k)
SELECT 'form' || k || '.xlsx' AS path, 0 AS sheet_index, n AS n_columns,
       concat_ws('; ', CASE WHEN n < 15 THEN 'Expected at least 15 columns, got ' || n END,
                 CASE WHEN NOT a THEN 'Missing critical header: Email' END, CASE WHEN NOT b THEN 'Missing critical header: Name' END,
                 CASE WHEN NOT c THEN 'Missing critical header: Team Name' END) AS errors
FROM sheet""",
    "h5_similar_auto_map": """
WITH names AS (SELECT ['Email', 'E-mail Address', 'email_id', 'Full Name', 'Name', 'Problem Statement', 'proof link', 'Assigned',
                       'Remarks (if any)', 'Date'] AS h),
heads AS (SELECT c_custkey AS k, CAST(j AS INTEGER) AS position, lower(h[(c_custkey * 7 + j * (1 + c_custkey % 3)) % 10 + 1]) AS low,
                 h[(c_custkey * 7 + j * (1 + c_custkey % 3)) % 10 + 1] AS header FROM customer, names, range(6) AS r(j)),
fields AS (SELECT unnest(['email', 'name', 'problem_statement', 'proof_link', 'assigned_to', 'remarks']) AS field),
fits AS (
  SELECT k, field, position, header FROM heads, fields
  WHERE contains(field, replace(low, ' ', '_')) OR contains(low, field) OR contains(replace(field, '_', ' '), low)
     OR contains(low, replace(field, '_', ' '))),
chosen AS (SELECT k, field, arg_max(header, position) AS header FROM fits GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS path, 0 AS sheet_index, field, min(position) AS position
FROM chosen JOIN heads USING (k, header) GROUP BY k, field""",
}
