"""Oracle SQL (DuckDB dialect) for sink and streaming queries that have one."""

from __future__ import annotations

from rollcall.plans.fixture_sql import with_views as W
from rollcall.plans.oracle_links import ORACLE as _LINKS
from rollcall.plans.oracle_links import PAGES, RUN, SIGNALS, VERDICTS
from rollcall.plans.oracle_merge import EMAIL_RE, ORACLE as _MERGE
from rollcall.plans.oracle_reports import ORACLE as _REPORTS


def _txt(c: str) -> str:
    return f"COALESCE(CAST({c} AS VARCHAR), '')"


def _ts(c: str) -> str:
    return f"COALESCE(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')"


A16 = _REPORTS["a16_slot_number_report"]

ORACLE = {
    "o1_workshop_export_rows": W(f"""
SELECT {_txt('b.email')} AS email, {_txt('b.form_name')} AS form_name, {_txt('b.name')} AS name,
       {_ts('b.time_slot')} AS time_slot, {_txt('b.time_slot_range')} AS time_slot_range,
       {_ts('b.created_at')} AS created_at, {_txt('u.name')} AS user_name, {_txt('u.phone_number')} AS phone_number,
       {_txt('u.designation')} AS designation, {_txt('u.occupation')} AS occupation, '' AS linkedin
FROM bookings b LEFT JOIN participants u ON b.email = u.email
WHERE b.form_name = 'Workshop 1' AND b.time_slot_range = '20 Nov, 4:00 - 7:00 PM'""", "participants", "bookings"),
    "o3_report_grid": """
SELECT COALESCE(CAST(workshop_number AS VARCHAR), '') AS "Workshop Number",
       COALESCE(CAST(time_slot_number AS VARCHAR), '') AS "Time Slot Number",
       COALESCE(time_slot, 'No Time Slot') AS "Time Slot", COALESCE(occupation, 'Unknown') AS "Occupation",
       CAST(COALESCE(count, 0) AS BIGINT) AS "Count"
FROM (""" + A16 + ") grid",
    "o4_json_lines": W("""
SELECT to_json(struct_pack(workshop_name := workshop_name, total_count := total_count, valid_count := valid_count,
                           invalid_count := invalid_count))::VARCHAR AS value
FROM (SELECT workshop_name, COUNT(*) AS total_count, COUNT(CASE WHEN valid THEN 1 END) AS valid_count,
             COUNT(CASE WHEN valid IS NOT TRUE THEN 1 END) AS invalid_count
      FROM submissions GROUP BY workshop_name) s""", "submissions"),
    "x1_merge_stream": _MERGE["u1_upsert_participants"],
    "x2_validation_totals_stream": _LINKS["v9_run_totals"],
    "s1_delimited_scan": W("""
SELECT CAST(row_number() OVER (PARTITION BY kind, row_number_in_file % 16 ORDER BY row_number_in_file) + 1 AS BIGINT) AS row_number,
       CAST(row_number_in_file AS VARCHAR) AS row_number_in_file, COALESCE(email, '') AS email,
       COALESCE(name, '') || CASE WHEN kind = 1 THEN chr(10) || ';;",;,second' ELSE '' END AS name,
       COALESCE(phone, '') AS phone, COALESCE(created_text, '') AS created_text, COALESCE(slot_text, '') AS slot_text,
       CASE WHEN kind < 2 THEN COALESCE(flag_text, '') END AS flag_text,
       CASE WHEN kind < 2 THEN COALESCE(degree_text, '') END AS degree_text,
       CASE WHEN kind = 1 THEN 'x' || CAST(row_number_in_file AS VARCHAR) WHEN kind = 0 AND row_number_in_file % 2 = 0 THEN '' END AS extra,
       CAST(CASE kind WHEN 0 THEN CASE WHEN row_number_in_file % 2 = 0 THEN 10 ELSE 8 END WHEN 1 THEN 9 ELSE 6 END AS INTEGER) AS n_cells
FROM (SELECT *, row_number_in_file % 3 AS kind FROM raw_rows) r""", "raw_rows"),
    "c19_participant_file_all_fields": W("""
SELECT email, name, phone_number, NULLIF(gender, '') AS gender, country, state, city, date_of_birth, designation,
       'Stream ' || (u % 5) AS class_stream, CASE WHEN u % 3 <> 0 THEN CAST(2000 + u % 25 AS INTEGER) END AS degree_passout_year,
       NULLIF(occupation, '') AS occupation, CASE WHEN u % 4 <> 1 THEN 'https://in.example/' || u END AS linkedin,
       prior_cohort AS participated_in_academy_1_0,
       CASE WHEN u % 7 <> 2 THEN registration_date_time ELSE TIMESTAMP '2025-01-15 09:30:00' END AS registration_date_time
FROM (SELECT *, CAST(regexp_extract(email, '^user([0-9]+)@', 1) AS BIGINT) AS u FROM participants) p""", "participants"),
    "s2_participant_workbooks": W("""
SELECT email, name, phone_number, NULLIF(gender, '') AS gender, country, state, city, date_of_birth, designation,
       'Stream ' || (u % 5) AS class_stream, CASE WHEN u % 3 <> 0 THEN CAST(2000 + u % 25 AS INTEGER) END AS degree_passout_year,
       NULLIF(occupation, '') AS occupation, CASE WHEN u % 4 <> 1 THEN 'https://in.example/' || u END AS linkedin,
       CASE u % 4 WHEN 0 THEN true WHEN 2 THEN COALESCE(prior_cohort, false) ELSE false END AS participated_in_academy_1_0,
       CASE WHEN u % 7 <> 2 THEN registration_date_time ELSE TIMESTAMP '2025-01-15 09:30:00' END AS registration_date_time
FROM (SELECT *, CAST(regexp_extract(email, '^user([0-9]+)@', 1) AS BIGINT) AS u FROM participants) p""", "participants"),
    "c19_participant_sheet_parse": W(f"""
, t AS (SELECT NULLIF(regexp_replace(email, '^\\s+|\\s+$', '', 'g'), '') AS email,
               NULLIF(regexp_replace(name, '^\\s+|\\s+$', '', 'g'), '') AS name,
               phone, degree_text FROM raw_rows
        WHERE COALESCE(CAST(row_number_in_file AS VARCHAR), '') <> '' OR COALESCE(email, '') <> ''
           OR COALESCE(name, '') <> '' OR COALESCE(phone, '') <> '')
SELECT lower(email) AS email, name,
       CASE WHEN COALESCE(phone, '') <> '' AND length(regexp_replace(phone, '\\D', '', 'g')) >= 10
            THEN regexp_replace(phone, '\\D', '', 'g') END AS phone_number,
       CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS state,
       CAST(NULL AS VARCHAR) AS city, CAST(NULL AS DATE) AS date_of_birth, CAST(NULL AS VARCHAR) AS designation,
       CAST(NULL AS VARCHAR) AS class_stream,
       CAST(NULLIF(regexp_extract(degree_text, '\\d{{4}}', 0), '') AS INTEGER) AS degree_passout_year,
       CAST(NULL AS VARCHAR) AS occupation, CAST(NULL AS VARCHAR) AS linkedin,
       false AS participated_in_academy_1_0, TIMESTAMP '2025-01-15 09:30:00' AS registration_date_time
FROM t WHERE email IS NOT NULL AND name IS NOT NULL AND regexp_matches(email, '{EMAIL_RE}')""", "raw_rows"),
    "x3_progress_sink_lines": W(f""", {PAGES}, {SIGNALS}, {VERDICTS}, {RUN}
SELECT link, reason, status, current, total, validated, failed, updated FROM run
UNION ALL
SELECT NULL, NULL, 'Complete', COUNT(*), COUNT(*), COUNT(CASE WHEN valid THEN 1 END), COUNT(CASE WHEN NOT valid THEN 1 END),
       COUNT(CASE WHEN valid AND (likes > 0 OR comments > 0) THEN 1 END) FROM verdicts""", "linked_pages", "submissions"),
    "c_weekly_sheet_import": W("""
SELECT week_number, lower(trim(email)) AS email, NULLIF(trim(github_link), '') AS github_link,
       NULLIF(trim(blog_link), '') AS blog_link, date_trunc('second', created_at) AS created_at,
       CAST(NULL AS TIMESTAMP) AS updated_at,
       CAST(regexp_extract(email, '^user([0-9]+)@', 1) AS BIGINT) + 2 AS row_number
FROM weekly""", "weekly"),
    "c_lab_sheet_import": W("""
SELECT workshop_name, lower(trim(email)) AS email, NULLIF(trim(name), '') AS name,
       NULLIF(trim(problem_statement), '') AS problem_statement,
       NULLIF(trim(proof_link), '') AS hands_on_lab_proof_link, COALESCE(valid, false) AS valid,
       NULLIF(trim(assigned_to), '') AS assigned_to, date_trunc('second', assigned_at) AS assigned_at,
       CAST(NULL AS VARCHAR) AS blog_submission, NULLIF(trim(remarks), '') AS remarks,
       CAST(regexp_extract(email, '^user([0-9]+)@', 1) AS BIGINT) + 2 AS row_number
FROM labs""", "labs"),
    "s2_o3_grid_workbook_roundtrip": """
SELECT COALESCE(CAST(workshop_number AS VARCHAR), '') AS "Workshop Number",
       COALESCE(CAST(time_slot_number AS VARCHAR), '') AS "Time Slot Number",
       COALESCE(time_slot, 'No Time Slot') AS "Time Slot", COALESCE(occupation, 'Unknown') AS "Occupation",
       CAST(COALESCE(count, 0) AS VARCHAR) AS "Count"
FROM (""" + A16 + ") grid",
}
