"""Oracle SQL (DuckDB dialect) for merge, change-capture and import queries."""

from __future__ import annotations

from rollcall.plans.fixture_sql import with_views as W

TS = "TIMESTAMP '2025-01-15 09:30:00'"

BATCH = """
batch AS (
  SELECT email, name, CAST(substr(workshop_name, 10, 3) AS INTEGER) AS row_number,
         CASE WHEN comments = 0 THEN NULL ELSE created_at END AS registration_date_time,
         team_id AS occupation,
         CASE WHEN likes % 2 = 0 THEN NULL ELSE '77' || CAST(likes AS VARCHAR) END AS phone_number
  FROM submissions),
lastrec AS (
  SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY email ORDER BY row_number DESC) AS rn FROM batch b)
  WHERE rn = 1),
lastreg AS (
  SELECT email, max_by(registration_date_time, CASE WHEN registration_date_time IS NOT NULL THEN row_number END)
           AS registration_date_time
  FROM batch GROUP BY email),
last AS (
  SELECT r.email, r.name, r.row_number, g.registration_date_time, r.occupation, r.phone_number
  FROM lastrec r JOIN lastreg g ON r.email = g.email),
first AS (
  SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY email ORDER BY row_number) AS rn FROM batch b)
  WHERE rn = 1)"""

UPSERT_STATE = f"""
SELECT COALESCE(t.email, s.email) AS email,
       CASE WHEN s.email IS NOT NULL THEN s.name ELSE t.name END AS name,
       CASE WHEN t.email IS NULL THEN COALESCE(s.registration_date_time, {TS})
            WHEN s.email IS NULL THEN t.registration_date_time
            ELSE COALESCE(s.registration_date_time, t.registration_date_time) END AS registration_date_time,
       CASE WHEN s.email IS NOT NULL THEN s.phone_number ELSE t.phone_number END AS phone_number,
       t.gender, t.country, t.state, t.city, t.date_of_birth, t.designation,
       CASE WHEN s.email IS NOT NULL THEN s.occupation ELSE t.occupation END AS occupation,
       CASE WHEN t.email IS NULL THEN false ELSE t.prior_cohort END AS prior_cohort
FROM participants t FULL OUTER JOIN last s ON t.email = s.email"""

CREATE_STATE = f"""
SELECT * FROM participants
UNION ALL
SELECT email, name, COALESCE(registration_date_time, {TS}), phone_number, NULL, NULL, NULL, NULL, NULL, NULL,
       occupation, false
FROM first WHERE email NOT IN (SELECT email FROM participants)"""

UPDATE_STATE = """
SELECT t.email,
       CASE WHEN s.email IS NOT NULL THEN s.name ELSE t.name END AS name,
       CASE WHEN s.email IS NOT NULL THEN COALESCE(s.registration_date_time, t.registration_date_time)
            ELSE t.registration_date_time END AS registration_date_time,
       CASE WHEN s.email IS NOT NULL THEN s.phone_number ELSE t.phone_number END AS phone_number,
       t.gender, t.country, t.state, t.city, t.date_of_birth, t.designation,
       CASE WHEN s.email IS NOT NULL THEN s.occupation ELSE t.occupation END AS occupation,
       t.prior_cohort
FROM participants t LEFT JOIN last s ON t.email = s.email"""

NEW_KEYS = "(SELECT COUNT(DISTINCT email) FROM batch WHERE email NOT IN (SELECT email FROM participants))"

UPDATES = """
updates AS (SELECT workshop_name, email, proof_link AS project_link, valid FROM labs)"""

WEEKLY_BATCH = """
wb AS (
  SELECT CAST(floor((day(ts) - 1) / 7) AS INTEGER) + 1 AS week_number,
         'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
         'https://github.com/new/' || CAST(event_id AS VARCHAR) AS github_link,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 100 AS INTEGER) END AS likes,
         ts AS created_at, event_id AS row_number
  FROM events),
wr AS (
  SELECT week_number, email,
         max_by(github_link, row_number) AS github_link,
         max_by(likes, CASE WHEN likes IS NOT NULL THEN row_number END) AS likes,
         min_by(created_at, row_number) AS created_at
  FROM wb GROUP BY week_number, email)"""

NEW_GRANTS = """
new_grants AS (SELECT l_suppkey AS user_id, l_partkey + l_linenumber AS permission_id FROM lineitem)"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _iso(s: str) -> str:
    clean = f"regexp_replace(regexp_replace({s}, '[Zz]', '', 'g'), '[+-]\\d{{2}}:?\\d{{2}}$', '')"
    base = f"split_part({clean}, '.', 1)"
    frac = f"regexp_replace(CASE WHEN contains({clean}, '.') THEN substr({clean}, strpos({clean}, '.') + 1) ELSE '' END, '\\D', '', 'g')"
    text = f"replace({base}, 'T', ' ') || '.' || rpad(left({frac}, 6), 6, '0')"
    return f"CASE WHEN contains({s}, 'T') THEN try_strptime({text}, '%Y-%m-%d %H:%M:%S.%f') END"


PLAIN_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y",
                 "%m/%d/%Y %H:%M:%S", "%m/%d/%Y", "%d %b %Y %H:%M:%S", "%d %b %Y %H:%M", "%d %B %Y %H:%M:%S",
                 "%d %B %Y %H:%M"]


def _slot_subquery(src: str, table: str, keep: str, year: int = 2024) -> str:
    """Subquery adding ``slot_ts`` (start of a time-slot text) to ``table``."""
    return f"""
(SELECT *, CASE WHEN contains(s, ',') AND contains(s, '-') AND day IS NOT NULL AND t IS NOT NULL
                THEN make_timestamp(year(day), month(day), day(day), hour(t), minute(t), 0) END AS slot_ts
 FROM (SELECT *, COALESCE(try_strptime(dp, '%d %b %Y'), try_strptime(dp, '%d %B %Y')) AS day,
              COALESCE(try_strptime(st, '%I:%M %p'), try_strptime(st, '%I:%M%p'), try_strptime(st, '%H:%M')) AS t
       FROM (SELECT *, CASE WHEN contains(upper(st0), 'PM') OR contains(upper(st0), 'AM') THEN st0
                            WHEN contains(upper(tp), 'PM') THEN st0 || ' PM'
                            WHEN contains(upper(tp), 'AM') THEN st0 || ' AM' ELSE st0 END AS st
             FROM (SELECT *, CASE WHEN contains(tp, ' - ') THEN trim(split_part(tp, ' - ', 1))
                                  WHEN contains(tp, '-') AND NOT starts_with(tp, '-') THEN trim(split_part(tp, '-', 1))
                                  ELSE tp END AS st0
                   FROM (SELECT {keep}, s, trim(regexp_extract(s, '^[^,]*,(.*)$', 1)) AS tp,
                                trim(split_part(s, ',', 1)) || ' {year}' AS dp
                         FROM (SELECT *, {_strip(src)} AS s FROM {table}) a) b) c) d) e)"""


def _datetime(s: str, slot: str) -> str:
    plain = ", ".join(f"try_strptime({s}, '{f}')" for f in PLAIN_FORMATS)
    return f"CASE WHEN {s} <> '' THEN COALESCE({_iso(s)}, {slot}, {plain}) END"


EMAIL_RE = "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$"

IMPORT = f"""
typed AS (
  SELECT row_number_in_file AS row_number,
         NULLIF({_strip('email')}, '') AS email,
         NULLIF({_strip('name')}, '') AS name,
         NULLIF({_strip('phone')}, '') AS phone_number,
         {_datetime('ct', 'slot_ts')} AS registration_date_time,
         COALESCE(lower(flag_text) IN ('true', '1', 'yes', 'y', 'on'), false) AS participated_in_academy_1_0,
         CASE WHEN regexp_matches({_strip('degree_text')}, '^[+-]?\\d{{1,9}}$')
              THEN CAST({_strip('degree_text')} AS INTEGER) END AS degree_passout_year
  FROM (SELECT x.*, sl.slot_ts, {_strip('x.created_text')} AS ct
        FROM {_slot_subquery('created_text', 'raw_rows', 'row_number_in_file AS rk')} sl
        JOIN raw_rows x ON x.row_number_in_file = sl.rk) y),
checked AS (
  SELECT *, CASE WHEN email IS NULL OR name IS NULL
                 THEN 'Missing required fields: ' || concat_ws(', ', CASE WHEN email IS NULL THEN 'email' END,
                                                                CASE WHEN name IS NULL THEN 'name' END)
                 WHEN NOT regexp_matches(email, '{EMAIL_RE}') THEN 'Invalid email: ' || email END AS reason
  FROM typed),
accepted AS (
  SELECT row_number, lower(email) AS email, name, phone_number,
         COALESCE(registration_date_time, {TS}) AS registration_date_time,
         participated_in_academy_1_0, degree_passout_year
  FROM checked WHERE reason IS NULL),
rejected AS (
  SELECT row_number, 'Row ' || CAST(row_number AS VARCHAR) || ': ' || reason AS error
  FROM checked WHERE reason IS NOT NULL)"""

# Raw rows over seven files of three sheets as bookings: parsed, admitted, and what became of each.
BOOKING_IMPORT = f"""
cells AS (
  SELECT 'file' || (row_number_in_file % 7) || '.csv' AS path, CAST(row_number_in_file % 3 AS INTEGER) AS sheet_index,
         row_number_in_file AS k, coalesce(email, '') AS email,
         coalesce(CASE WHEN row_number_in_file % 11 = 0 THEN repeat(trim(name), 20) ELSE name END, '') AS name FROM raw_rows),
trimmed AS (SELECT path, sheet_index, k, {_strip('email')} AS mail, {_strip('name')} AS who FROM cells WHERE email || name <> ''),
judged AS (
  SELECT path, sheet_index, k, lower(mail) AS mail, who,
         CASE WHEN mail = '' AND who = '' THEN 'Missing required fields: email, name'
              WHEN mail = '' THEN 'Missing required fields: email' WHEN who = '' THEN 'Missing required fields: name'
              WHEN NOT regexp_matches(mail, '{EMAIL_RE}') THEN 'Invalid email: ' || mail
              WHEN length(who) > 255 THEN 'value too long for type character varying(255)'
              WHEN lower(mail) NOT IN (SELECT email FROM participants WHERE prior_cohort)
              THEN 'insert or update on table "bookings" violates foreign key constraint' END AS why
  FROM trimmed),
good AS (SELECT * FROM judged WHERE why IS NULL),
fates AS (
  SELECT path, sheet_index, CASE WHEN mail IN (SELECT email FROM bookings WHERE form_name = 'Workshop 1') THEN 'updated'
              WHEN row_number() OVER (PARTITION BY mail ORDER BY path, sheet_index, k) = 1 THEN 'created' ELSE 'updated' END AS fate
  FROM good UNION ALL SELECT path, sheet_index, 'skipped' FROM judged WHERE why IS NOT NULL)"""

# Records matched on (email, name), or on the e-mail alone where the name is missing.
NAMED = """
named AS (SELECT email, CASE WHEN row_number % 2 <> 0 THEN name END AS name, occupation, phone_number, row_number FROM batch),
met AS (SELECT p.email, n.name, n.occupation, n.phone_number, n.row_number
        FROM named n JOIN participants p ON n.email = p.email AND coalesce(n.name = p.name, true)),
final AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY email ORDER BY row_number DESC) = 1),
stored AS (SELECT p.email, p.name, p.occupation, p.phone_number, f.email IS NOT NULL AS hit, f.name AS b_name,
                  f.occupation AS b_occupation, f.phone_number AS b_phone
           FROM participants p LEFT JOIN final f ON p.email = f.email),
born AS (SELECT * FROM named WHERE email NOT IN (SELECT email FROM participants)
         QUALIFY row_number() OVER (PARTITION BY email ORDER BY row_number) = 1),
-- later records of the batch that agree with a row inserted before them
again AS (SELECT n.* FROM named n JOIN born b ON n.email = b.email AND n.row_number > b.row_number AND (n.name IS NULL OR n.name = b.name)),
latest AS (SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY email ORDER BY row_number DESC) = 1),
arrived AS (SELECT b.email, CASE WHEN l.email IS NULL THEN b.name ELSE l.name END AS name,
                   CASE WHEN l.email IS NULL THEN b.occupation ELSE l.occupation END AS occupation,
                   CASE WHEN l.email IS NULL THEN b.phone_number ELSE l.phone_number END AS phone_number
            FROM born b LEFT JOIN latest l ON b.email = l.email)"""

ORACLE = {
    "u1_upsert_participants": W(f", {BATCH}\n{UPSERT_STATE}", "participants", "submissions"),
    "u2_create_participants": W(f", {BATCH}\n{CREATE_STATE}", "participants", "submissions"),
    "u3_update_participants": W(f", {BATCH}\n{UPDATE_STATE}", "participants", "submissions"),
    "u12_upsert_counts": W(f""", {BATCH}
SELECT {NEW_KEYS} AS inserted, (SELECT COUNT(*) FROM batch) - {NEW_KEYS} AS updated""",
                           "participants", "submissions"),
    "u12_create_counts": W(f""", {BATCH}
SELECT {NEW_KEYS} AS inserted, CAST(0 AS BIGINT) AS updated""", "participants", "submissions"),
    "u12_update_counts": W(f""", {BATCH}
SELECT CAST(0 AS BIGINT) AS inserted,
       (SELECT COUNT(*) FROM batch WHERE email IN (SELECT email FROM participants)) AS updated""",
                           "participants", "submissions"),
    "u4_partial_update_submissions": W(f""", {UPDATES}
SELECT t.workshop_name, t.email, t.name,
       CASE WHEN u.email IS NOT NULL THEN COALESCE(u.project_link, t.project_link) ELSE t.project_link END
         AS project_link,
       CASE WHEN u.email IS NOT NULL THEN COALESCE(u.valid, t.valid) ELSE t.valid END AS valid,
       t.team_id, t.likes, t.comments, t.created_at
FROM submissions t LEFT JOIN updates u ON t.workshop_name = u.workshop_name AND t.email = u.email""",
                                       "submissions", "labs"),
    "u4_partial_update_count": W(f""", {UPDATES}
SELECT COUNT(*) AS updated
FROM submissions t JOIN updates u ON t.workshop_name = u.workshop_name AND t.email = u.email
WHERE u.project_link IS NOT NULL OR u.valid IS NOT NULL""", "submissions", "labs"),
    "u6_weekly_conflict_merge": W(f""", {WEEKLY_BATCH}
SELECT COALESCE(t.week_number, s.week_number) AS week_number, COALESCE(t.email, s.email) AS email,
       CASE WHEN s.email IS NOT NULL THEN s.github_link ELSE t.github_link END AS github_link,
       CASE WHEN s.email IS NOT NULL THEN NULL ELSE t.blog_link END AS blog_link,
       t.valid AS valid,
       CASE WHEN s.email IS NOT NULL THEN COALESCE(s.likes, t.likes) ELSE t.likes END AS likes,
       t.comments AS comments,
       t.github_valid AS github_valid,
       CASE WHEN t.email IS NULL THEN COALESCE(s.created_at, {TS}) ELSE t.created_at END AS created_at
FROM weekly t FULL OUTER JOIN wr s ON t.week_number = s.week_number AND t.email = s.email""", "weekly"),
    "u8_insert_or_ignore_grants": W(f""", {NEW_GRANTS}
SELECT user_id, permission_id FROM access_grants
UNION
SELECT user_id, permission_id FROM new_grants""", "access_grants"),
    "u15_delete_feedback_participants": W("""
SELECT * FROM participants
WHERE email NOT IN (SELECT email FROM bookings WHERE form_name = 'Feedback Form')""", "participants", "bookings"),
    "u16_replace_grant_sets": W(f""", {NEW_GRANTS}
SELECT user_id, permission_id FROM access_grants WHERE user_id NOT IN (SELECT user_id FROM new_grants)
UNION ALL
SELECT DISTINCT user_id, permission_id FROM new_grants""", "access_grants"),
    "u17_grant_all_to_user": W("""
SELECT user_id, permission_id FROM access_grants
UNION
SELECT 7 AS user_id, permission_id FROM access_permissions""", "access_permissions", "access_grants"),
    "u9_match_on_name_upsert": W(f""", {BATCH},
b2 AS (SELECT email, CASE WHEN row_number % 2 = 0 THEN NULL ELSE name END AS name, occupation, phone_number,
              row_number FROM batch),
hits AS (SELECT t.email AS tk, b.* FROM b2 b JOIN participants t
         ON t.email = b.email AND (b.name IS NULL OR t.name = b.name)),
lasthit AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY tk ORDER BY row_number DESC) AS rn2
                           FROM hits h) WHERE rn2 = 1)
SELECT t.email,
       CASE WHEN l.tk IS NOT NULL THEN l.name ELSE t.name END AS name,
       CASE WHEN l.tk IS NOT NULL THEN l.occupation ELSE t.occupation END AS occupation,
       CASE WHEN l.tk IS NOT NULL THEN l.phone_number ELSE t.phone_number END AS phone_number
FROM participants t LEFT JOIN lasthit l ON t.email = l.tk""", "participants", "submissions"),
    "u9_upsert": W(f""", {BATCH}, {NAMED}
SELECT email, CASE WHEN hit THEN b_name ELSE name END AS name, CASE WHEN hit THEN b_occupation ELSE occupation END AS occupation,
       CASE WHEN hit THEN b_phone ELSE phone_number END AS phone_number FROM stored
UNION ALL SELECT email, name, occupation, phone_number FROM arrived""", "participants", "submissions"),
    "u9_create": W(f""", {BATCH}, {NAMED}
SELECT email, name, occupation, phone_number FROM stored
UNION ALL SELECT email, name, occupation, phone_number FROM born""", "participants", "submissions"),
    "u9_rejected": W(f""", {BATCH}, {NAMED}
SELECT email, row_number FROM named n
WHERE name IS NOT NULL AND email IN (SELECT email FROM participants)
  AND NOT EXISTS (SELECT 1 FROM participants p WHERE p.email = n.email AND p.name = n.name)
UNION ALL
SELECT n.email, n.row_number FROM named n JOIN born b ON n.email = b.email AND n.row_number > b.row_number
WHERE n.name IS NOT NULL AND n.name IS DISTINCT FROM b.name""",
                     "participants", "submissions"),
    "u9_in_batch_counts": W(f""", {BATCH}, {NAMED}
SELECT (SELECT count(*) FROM born) AS inserted, (SELECT count(*) FROM met) + (SELECT count(*) FROM again) AS updated""",
                            "participants", "submissions"),
    "u9_changes": W(f""", {BATCH}, {NAMED}
SELECT 'participants' AS table_name, 'UPDATE' AS operation_type, email AS record_identifier, {TS} AS log_ts,
       email AS old_email, name AS old_name, occupation AS old_occupation, phone_number AS old_phone_number,
       email AS new_email, b_name AS new_name, b_occupation AS new_occupation, b_phone AS new_phone_number
FROM stored WHERE hit
UNION ALL
SELECT 'participants', 'INSERT', email, {TS}, NULL, NULL, NULL, NULL, email, name, occupation, phone_number FROM arrived""",
                    "participants", "submissions"),
    "l1_change_capture_upsert": W(f""", {BATCH},
latest AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY email ORDER BY row_number DESC) = 1)
SELECT 'participants' AS table_name, CASE WHEN t.email IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
       s.email AS record_identifier, {TS} AS log_ts,
       t.email AS old_email, t.name AS old_name, t.occupation AS old_occupation, t.phone_number AS old_phone_number,
       t.city AS old_city, CAST(t.prior_cohort AS VARCHAR) AS old_prior_cohort,
       s.email AS new_email, s.name AS new_name, s.occupation AS new_occupation, s.phone_number AS new_phone_number,
       t.city AS new_city, CAST(coalesce(t.prior_cohort, false) AS VARCHAR) AS new_prior_cohort
FROM latest s LEFT JOIN participants t ON s.email = t.email""", "participants", "submissions"),
    "l1_statement_log": W(f""", {BATCH},
steps AS (
  SELECT b.*, row_number() OVER k AS n, lag(name) OVER k AS name_0, lag(occupation) OVER k AS job_0, lag(phone_number) OVER k AS phone_0,
         last_value(registration_date_time IGNORE NULLS) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_0,
         last_value(registration_date_time IGNORE NULLS) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_1
  FROM batch b WINDOW k AS (PARTITION BY email ORDER BY row_number)),
told AS (
  SELECT s.*, t.email IS NULL AS fresh, t.name AS t_name, t.occupation AS t_job, t.phone_number AS t_phone, t.city AS t_city,
         t.registration_date_time AS t_seen, t.prior_cohort AS t_prior
  FROM steps s LEFT JOIN participants t USING (email))
SELECT CASE WHEN fresh AND n = 1 THEN 'INSERT' ELSE 'UPDATE' END AS operation_type, email AS record_identifier, row_number,
       CASE WHEN n > 1 OR NOT fresh THEN email END AS old_email, CASE WHEN n = 1 THEN t_name ELSE name_0 END AS old_name,
       CASE WHEN n = 1 THEN t_job ELSE job_0 END AS old_occupation, CASE WHEN n = 1 THEN t_phone ELSE phone_0 END AS old_phone_number,
       t_city AS old_city, CASE WHEN n = 1 THEN t_seen ELSE coalesce(seen_0, t_seen, {TS}) END AS old_registration_date_time,
       CAST(CASE WHEN n = 1 THEN t_prior ELSE coalesce(t_prior, false) END AS VARCHAR) AS old_prior_cohort,
       email AS new_email, name AS new_name, occupation AS new_occupation, phone_number AS new_phone_number, t_city AS new_city,
       coalesce(seen_1, t_seen, {TS}) AS new_registration_date_time, CAST(coalesce(t_prior, false) AS VARCHAR) AS new_prior_cohort
FROM told""", "participants", "submissions"),
    "l2_record_identifiers": W("""
SELECT 'weekly' AS table_name, COALESCE(CAST(week_number AS VARCHAR), 'NULL') || '|' || COALESCE(email, 'NULL') AS rid
FROM weekly
UNION ALL SELECT 'bookings', email || '|' || form_name FROM bookings
UNION ALL SELECT 'submissions', workshop_name || '|' || email FROM submissions""",
                               "bookings", "submissions", "weekly"),
    "c1_c4_clean_contacts": W(f"""
SELECT row_number_in_file,
       NULLIF({_strip('name')}, '') AS name,
       lower({_strip('email')}) AS email_key,
       COALESCE(regexp_matches({_strip('email')}, '{EMAIL_RE}'), false) AS email_valid,
       CASE WHEN length(regexp_replace(phone, '\\D', '', 'g')) >= 10 THEN regexp_replace(phone, '\\D', '', 'g') END
         AS phone
FROM raw_rows""", "raw_rows"),
    "c5_c6_parse_created": W(f"""
SELECT row_number_in_file, created_text, {_datetime('ct', 'slot_ts')} AS created_at,
       {_iso('ct')} AS created_iso
FROM (SELECT x.row_number_in_file, x.created_text, {_strip('x.created_text')} AS ct, sl.slot_ts
      FROM {_slot_subquery('created_text', 'raw_rows', 'row_number_in_file AS rk')} sl
      JOIN raw_rows x ON x.row_number_in_file = sl.rk) y""", "raw_rows"),
    "c7_c8_parse_slot": W(f"""
SELECT rk AS row_number_in_file, slot_ts AS time_slot, NULLIF(s, '') AS time_slot_range
FROM {_slot_subquery('slot_text', 'raw_rows', 'row_number_in_file AS rk')} sl""", "raw_rows"),
    "c9_c10_flags_and_years": W(f"""
SELECT row_number_in_file,
       COALESCE(lower(flag_text) IN ('true', '1', 'yes', 'y', 'on'), false) AS flag,
       row_number_in_file % 3 <> 0 AS flag_number, row_number_in_file % 4 <> 0 AS flag_half,
       COALESCE(upper(flag_text) = 'TRUE', false) AS flag_lab,
       CAST(NULLIF(regexp_extract(degree_text, '\\d{{4}}', 0), '') AS INTEGER) AS year_sheet,
       CASE WHEN regexp_matches({_strip('degree_text')}, '^[+-]?\\d{{1,9}}$')
            THEN CAST({_strip('degree_text')} AS INTEGER) END AS year_generic
FROM raw_rows""", "raw_rows"),
    "c11_c16_import_accepted": W(f", {IMPORT}\nSELECT * FROM accepted", "raw_rows"),
    "c15_import_rejects": W(f", {IMPORT}\nSELECT * FROM rejected", "raw_rows"),
    "c20_import_summary": W(f""", {IMPORT},
lastacc AS (SELECT DISTINCT email FROM accepted)
SELECT (SELECT COUNT(*) FROM raw_rows) AS rows,
       (SELECT COUNT(*) FROM lastacc WHERE email NOT IN (SELECT email FROM participants)) AS created,
       (SELECT COUNT(*) FROM accepted) - (SELECT COUNT(*) FROM lastacc WHERE email NOT IN (SELECT email FROM participants))
         AS updated,
       (SELECT COUNT(*) FROM rejected) AS skipped,
       (SELECT COUNT(*) FROM rejected) AS error_count, CAST(NULL AS BIGINT) AS row_number, CAST(NULL AS VARCHAR) AS error
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, row_number, error FROM rejected""", "participants", "raw_rows"),
    "c20_summary_by_file": W(f"""
, cell AS (
  SELECT 'file' || CAST(row_number_in_file % 7 AS VARCHAR) || '.csv' AS path,
         CAST(row_number_in_file % 3 AS INTEGER) AS sheet_index, email, name,
         length(coalesce(email, '') || coalesce(name, '') || coalesce(phone, '')) = 0 AS blank,
         coalesce({_strip('email')}, '') AS mail, coalesce({_strip('name')}, '') AS who FROM raw_rows),
judged AS (
  SELECT path, sheet_index, CASE WHEN blank THEN 'blank' WHEN mail = '' OR who = '' THEN 'missing'
                                 WHEN NOT regexp_matches(mail, '{EMAIL_RE}') THEN 'invalid' ELSE 'good' END AS fate
  FROM cell)
SELECT path, sheet_index, count(*) AS rows, count(*) FILTER (fate = 'blank') AS blank,
       count(*) FILTER (fate = 'good') AS accepted, count(*) FILTER (fate = 'missing') AS missing_fields,
       count(*) FILTER (fate = 'invalid') AS invalid_email
FROM judged GROUP BY ALL""", "raw_rows"),
    "c20_outcomes_by_file": W(f""", {BOOKING_IMPORT}
SELECT path, sheet_index, count(*) AS rows, count(*) FILTER (fate = 'created') AS created,
       count(*) FILTER (fate = 'updated') AS updated, CAST(0 AS BIGINT) AS unchanged, count(*) FILTER (fate = 'skipped') AS skipped
FROM fates GROUP BY ALL""", "participants", "bookings", "raw_rows"),
    "c_import_constraint_rejects": W(f""", {BOOKING_IMPORT}
SELECT path, sheet_index, k AS row_number, 'Row ' || k || ': ' || why AS error FROM judged WHERE why IS NOT NULL""",
                                     "participants", "bookings", "raw_rows"),
    "c20_import_state": W(f""", {BOOKING_IMPORT},
final AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY mail ORDER BY path DESC, sheet_index DESC, k DESC) = 1)
SELECT b.email, b.form_name, coalesce(f.who, b.name) AS name, b.time_slot, b.time_slot_range, b.created_at
FROM bookings b LEFT JOIN final f ON b.email = f.mail AND b.form_name = 'Workshop 1'
UNION ALL
SELECT mail, 'Workshop 1', who, NULL, NULL, {TS} FROM final
WHERE mail NOT IN (SELECT email FROM bookings WHERE form_name = 'Workshop 1')""", "participants", "bookings", "raw_rows"),
    "c21_workbook_summary": W("""
, sent AS (SELECT email, workshop_name, TRY_CAST(substr(workshop_name, 10, 3) AS INTEGER) AS sheet_index, false AS repeated FROM labs),
both_times AS (SELECT * FROM sent UNION ALL SELECT email, workshop_name, sheet_index, true FROM sent WHERE length(email) % 2 = 0),
fate AS (SELECT s.*, b.email IS NULL AND NOT repeated AS fresh FROM both_times s
         LEFT JOIN (SELECT DISTINCT email, form_name FROM bookings) b ON b.email = s.email AND b.form_name = s.workshop_name)
SELECT sheet_index, count(*) AS rows_read, CAST(sum(CAST(fresh AS INTEGER)) AS BIGINT) AS inserted,
       CAST(sum(CAST(NOT fresh AS INTEGER)) AS BIGINT) AS updated, count(DISTINCT workshop_name) AS workshops, false AS is_total
FROM fate GROUP BY sheet_index
UNION ALL
SELECT NULL, count(*), CAST(sum(CAST(fresh AS INTEGER)) AS BIGINT), CAST(sum(CAST(NOT fresh AS INTEGER)) AS BIGINT),
       count(DISTINCT workshop_name), true FROM fate""", "bookings", "labs"),
    "u5_weekly_update_mode": W(f""",
sup AS (
  SELECT CAST(floor((day(ts) - 1) / 7) AS INTEGER) + 1 AS week_number,
         'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
         CASE WHEN event_id % 2 = 0 THEN 'https://github.com/upd/' || CAST(event_id AS VARCHAR) END AS gl,
         CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS INTEGER) END AS lk,
         CASE WHEN event_id % 5 <> 0 THEN ts END AS ua, event_id AS row_number
  FROM events),
upd AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY week_number, email ORDER BY row_number DESC) AS rn
                       FROM sup s) WHERE rn = 1)
SELECT t.week_number, t.email,
       CASE WHEN u.email IS NOT NULL AND (u.gl IS NOT NULL OR u.lk IS NOT NULL) THEN COALESCE(u.gl, t.github_link)
            ELSE t.github_link END AS github_link,
       t.blog_link, t.valid,
       CASE WHEN u.email IS NOT NULL AND (u.gl IS NOT NULL OR u.lk IS NOT NULL) THEN COALESCE(u.lk, t.likes)
            ELSE t.likes END AS likes,
       t.comments, t.github_valid, t.created_at,
       CASE WHEN u.email IS NOT NULL AND (u.gl IS NOT NULL OR u.lk IS NOT NULL) THEN COALESCE(u.ua, {TS})
            ELSE t.created_at END AS updated_at
FROM weekly t LEFT JOIN upd u ON t.week_number = u.week_number AND t.email = u.email""", "weekly"),
    "u7_u14_insert_or_replace_bookings": W(f""",
bb AS (SELECT email, workshop_name AS form_name, name, assigned_at AS time_slot, problem_statement AS time_slot_range,
              created_at, created_at AS row_number FROM labs),
lastb AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY email, form_name ORDER BY row_number DESC) AS rn
                         FROM bb b) WHERE rn = 1),
firstb AS (SELECT email, form_name, min_by(created_at, row_number) AS c0 FROM bb GROUP BY email, form_name)
SELECT COALESCE(t.email, s.email) AS email, COALESCE(t.form_name, s.form_name) AS form_name,
       CASE WHEN s.email IS NOT NULL THEN s.name ELSE t.name END AS name,
       CASE WHEN s.email IS NOT NULL THEN s.time_slot ELSE t.time_slot END AS time_slot,
       CASE WHEN s.email IS NOT NULL THEN s.time_slot_range ELSE t.time_slot_range END AS time_slot_range,
       CASE WHEN t.email IS NULL THEN {TS} ELSE t.created_at END AS created_at,
       CASE WHEN s.email IS NOT NULL THEN {TS} ELSE t.created_at END AS updated_at
FROM bookings t FULL OUTER JOIN lastb s ON t.email = s.email AND t.form_name = s.form_name""", "bookings", "labs"),
    "u10_update_by_occupation": W("""
SELECT t.email, t.occupation,
       CASE WHEN s.occupation IS NOT NULL THEN s.designation ELSE t.designation END AS designation
FROM participants t
LEFT JOIN (SELECT DISTINCT c_mktsegment AS occupation, 'Lead of ' || c_mktsegment AS designation FROM customer) s
  ON t.occupation = s.occupation""", "participants"),
    "u10_update_by_occupation_count": W("""
SELECT CAST(0 AS BIGINT) AS inserted, COUNT(*) AS updated
FROM participants t JOIN (SELECT DISTINCT c_mktsegment AS occupation FROM customer) s ON t.occupation = s.occupation""",
                                        "participants"),
}
