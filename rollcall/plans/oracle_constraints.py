"""Oracle SQL (DuckDB dialect) for constraint queries."""

from __future__ import annotations

from rollcall import schemas as SC
from rollcall.plans.fixture_sql import with_views as W

CHECKED = ["participants", "bookings", "submissions", "weekly", "labs"]
COLUMNS = {
    "participants": ["email", "name", "registration_date_time", "phone_number", "gender", "country", "state", "city",
                     "date_of_birth", "designation", "occupation", "prior_cohort"],
    "bookings": ["email", "form_name", "name", "time_slot", "time_slot_range", "created_at"],
    "submissions": ["workshop_name", "email", "name", "project_link", "valid", "team_id", "likes", "comments",
                    "created_at"],
    "weekly": ["week_number", "email", "github_link", "blog_link", "valid", "likes", "comments", "github_valid",
               "created_at"],
    "labs": ["workshop_name", "email", "name", "problem_statement", "proof_link", "valid", "assigned_to",
             "assigned_at", "remarks", "created_at"],
}


def _checks(kind: str) -> str:
    parts = []
    for t in CHECKED:
        if kind == "null":
            cols = [c for c in SC.NOT_NULL[t] if c in COLUMNS[t]]
            preds = {c: f"{c} IS NULL" for c in cols}
        else:
            preds = {c: f"length({c}) > {n}" for c, n in SC.WIDTHS[t].items() if c in COLUMNS[t]}
        for c, p in preds.items():
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"COUNT(CASE WHEN {p} THEN 1 END) AS violations FROM {t}")
    return "\nUNION ALL ".join(parts)


ORACLE = {
    "k1_duplicate_booking_keys_raw": """
SELECT email, form_name, COUNT(*) AS rows FROM (
  SELECT 'user' || CAST(o_custkey AS VARCHAR) || '@example.com' AS email,
         CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 29 = 0 THEN 'Feedback Form'
              ELSE 'Workshop ' || substr(o_orderpriority, 1, 1) END AS form_name
  FROM orders) o
GROUP BY email, form_name HAVING COUNT(*) > 1""",
    "k2_orphan_bookings": W("""
SELECT * FROM bookings WHERE email NOT IN (SELECT email FROM participants)""", "participants", "bookings"),
    "k2_orphan_counts": W("\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS orphans FROM {t} WHERE email NOT IN (SELECT email FROM participants)"
        for t in CHECKED if t != "participants"), *CHECKED),
    "k3_not_null_violations": W(_checks("null"), *CHECKED),
    "k4_length_violations": W(_checks("len"), *CHECKED),
    "k5_cascade_delete_counts": W("\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS kept FROM {t} "
        f"WHERE email NOT IN (SELECT email FROM participants WHERE prior_cohort)"
        for t in CHECKED if t != "participants"), *CHECKED),
    "k5_kept_bookings": W("""
SELECT * FROM bookings WHERE email NOT IN (SELECT email FROM participants WHERE prior_cohort)""", "participants", "bookings"),
    "k6_cascade_key_update_bookings": W("""
SELECT CASE WHEN p.email IS NOT NULL THEN 'renamed.' || b.email ELSE b.email END AS email,
       b.form_name, b.name, b.time_slot, b.time_slot_range, b.created_at
FROM bookings b LEFT JOIN (SELECT email FROM participants WHERE designation IS NULL) p ON b.email = p.email""",
                                        "participants", "bookings"),
    "k5_cascade_delete_log": W("""
, gone AS (SELECT email FROM participants WHERE prior_cohort)
SELECT 'bookings' AS table_name, 'DELETE' AS operation_type, email || '|' || form_name AS record_identifier,
       TIMESTAMP '2025-01-15 09:30:00' AS log_ts, true AS has_old
FROM bookings WHERE email IN (SELECT email FROM gone)
UNION ALL SELECT 'submissions', 'DELETE', workshop_name || '|' || email, TIMESTAMP '2025-01-15 09:30:00', true
FROM submissions WHERE email IN (SELECT email FROM gone)
UNION ALL SELECT 'weekly', 'DELETE', COALESCE(CAST(week_number AS VARCHAR), 'NULL') || '|' || COALESCE(email, 'NULL'),
       TIMESTAMP '2025-01-15 09:30:00', true
FROM weekly WHERE email IN (SELECT email FROM gone)
UNION ALL SELECT 'labs', 'DELETE', workshop_name || '|' || email, TIMESTAMP '2025-01-15 09:30:00', true
FROM labs WHERE email IN (SELECT email FROM gone)""", *CHECKED),
    "k6_cascade_key_update_log": W("""
SELECT 'bookings' AS table_name, 'UPDATE' AS operation_type, 'renamed.' || b.email || '|' || b.form_name
         AS record_identifier,
       TIMESTAMP '2025-01-15 09:30:00' AS log_ts, b.email AS old_email, 'renamed.' || b.email AS new_email
FROM bookings b JOIN (SELECT email FROM participants WHERE designation IS NULL) p ON b.email = p.email""",
                                   "participants", "bookings"),
}
