"""Oracle SQL (DuckDB dialect) for search, access and log queries."""

from __future__ import annotations

from rollcall.plans.fixture_sql import with_views as W

REQUESTS = """
SELECT DISTINCT l_suppkey AS user_id,
       'route_' || CAST(l_partkey + CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END AS VARCHAR) AS route_name
FROM lineitem"""

SUB_TEXT = ("lower(concat_ws(' ', COALESCE(workshop_name, ''), COALESCE(email, ''), COALESCE(name, ''), "
            "COALESCE(project_link, '')))")

NEWEST = "ORDER BY log_ts DESC NULLS FIRST, log_id DESC"

ORACLE = {
    "q1_participant_search": W("""
SELECT * FROM participants
WHERE contains(lower(concat_ws(' ', COALESCE(email, ''), COALESCE(name, ''), COALESCE(phone_number, ''),
                               COALESCE(country, ''))), 'user12')""", "participants"),
    "q1_indexed_participant_search": W("""
SELECT * FROM participants
WHERE contains(lower(concat_ws(' ', COALESCE(email, ''), COALESCE(name, ''), COALESCE(phone_number, ''),
                               COALESCE(country, ''))), 'user12')""", "participants"),
    "q1_submission_search": W(f"""
SELECT * FROM submissions WHERE contains({SUB_TEXT}, 'blog.example')""", "submissions"),
    "q1_lab_search": W("""
SELECT * FROM labs
WHERE contains(lower(concat_ws(' ', COALESCE(email, ''), COALESCE(name, ''), COALESCE(problem_statement, ''),
                               COALESCE(remarks, ''))), 'rework')""", "labs"),
    "q2_submission_status_workshop_filter": W("""
SELECT * FROM submissions WHERE valid IS NOT TRUE AND lower(COALESCE(workshop_name, '')) = 'workshop 2'""",
                                              "submissions"),
    "q3_submission_sort_likes_desc": W("""
SELECT workshop_name, email, likes FROM submissions
ORDER BY COALESCE(likes, 0) DESC, workshop_name, email""", "submissions"),
    "q3_submission_text_sort_positions": W("""
SELECT workshop_name, email,
       row_number() OVER (ORDER BY lower(COALESCE(workshop_name, '')), COALESCE(email, '')) AS position
FROM submissions""", "submissions"),
    "q4_workshop_facets": W("""
SELECT DISTINCT lower(workshop_name) AS workshop FROM submissions
WHERE workshop_name IS NOT NULL AND workshop_name <> '' ORDER BY 1""", "submissions"),
    "q5_search_result_count": W(f"""
SELECT COUNT(CASE WHEN contains({SUB_TEXT}, 'blog.example') AND valid IS TRUE THEN 1 END) AS visible,
       COUNT(*) AS total
FROM submissions""", "submissions"),
    "q6_newest_first_labs": W("""
SELECT workshop_name, email, created_at FROM labs ORDER BY created_at DESC NULLS FIRST""", "labs"),
    "p1_effective_permissions": W("""
SELECT g.permission_id, g.user_id, p.route_name, p.display_name, p.category
FROM access_grants g JOIN access_permissions p ON g.permission_id = p.permission_id
ORDER BY g.user_id, p.category NULLS FIRST, p.display_name""", "access_permissions", "access_grants"),
    "p2_effective_routes": W("""
SELECT user_id, '*' AS route_name, true AS all_routes FROM access_users WHERE is_admin
UNION ALL
SELECT DISTINCT g.user_id, p.route_name, false AS all_routes
FROM access_grants g JOIN access_permissions p ON g.permission_id = p.permission_id
WHERE g.user_id IN (SELECT user_id FROM access_users WHERE NOT COALESCE(is_admin, false))""",
                             "access_users", "access_permissions", "access_grants"),
    "p3_access_check": W(f"""
, requests AS ({REQUESTS})
SELECT r.user_id, r.route_name,
       COALESCE(u.is_admin, false) OR EXISTS (
         SELECT 1 FROM access_grants g JOIN access_permissions p ON g.permission_id = p.permission_id
         WHERE g.user_id = r.user_id AND p.route_name = r.route_name) AS allowed
FROM requests r LEFT JOIN access_users u ON r.user_id = u.user_id""",
                         "access_users", "access_permissions", "access_grants"),
    "p4_grants_by_category": W("""
SELECT COALESCE(p.category, 'Other') AS category, p.permission_id, p.route_name, p.display_name,
       p.permission_id IN (SELECT permission_id FROM access_grants WHERE user_id = 7) AS granted
FROM access_permissions p""", "access_permissions", "access_grants"),
    "l3_log_page": W(f"SELECT * FROM change_log {NEWEST} LIMIT 100 OFFSET 50", "change_log"),
    "l3_deep_page_stored_log": W(f"SELECT * FROM change_log {NEWEST} LIMIT 100 OFFSET 700", "change_log"),
    "l5_stored_log_by_operation": W(f"""
SELECT * FROM change_log WHERE operation_type = 'DELETE' {NEWEST} LIMIT 100 OFFSET 50""", "change_log"),
    "l6_stored_log_by_time": W(f"""
SELECT * FROM change_log
WHERE log_ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-05 12:00:00' {NEWEST} LIMIT 100""",
                               "change_log"),
    "l4_log_by_table": W(f"SELECT * FROM change_log WHERE table_name = 'submissions' {NEWEST} LIMIT 100",
                         "change_log"),
    "l5_log_by_operation": W(f"SELECT * FROM change_log WHERE operation_type = 'DELETE' {NEWEST} LIMIT 100",
                             "change_log"),
    "l6_log_by_time": W(f"""
SELECT * FROM change_log
WHERE log_ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-05 12:00:00' {NEWEST} LIMIT 100""",
                        "change_log"),
    "l7_record_history": W(f"""
SELECT * FROM change_log WHERE table_name = 'bookings' AND record_identifier = 'user41@example.com' {NEWEST}""",
                           "change_log"),
    "l8_log_query_dispatch": W(f"SELECT * FROM change_log WHERE table_name = 'weekly' {NEWEST} LIMIT 100",
                               "change_log"),
}
