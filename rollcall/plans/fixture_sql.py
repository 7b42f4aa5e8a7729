"""Fixture view bodies as SQL text (FIXTURES.md section C).

The oracle side of every registered query inlines the bodies it needs as
CTEs, so one statement runs in DuckDB over the bare driver tables.
"""

VIEW_SQL = {
    "participants": """
SELECT concat('user', CAST(c_custkey AS STRING), '@example.com') AS email,
       c_name AS name,
       CAST(DATE '2024-01-01' + CAST(c_custkey % 120 AS INT) AS TIMESTAMP) AS registration_date_time,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('98', CAST(10000000 + c_custkey AS STRING)) END AS phone_number,
       CASE c_custkey % 5 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 2 THEN 'Other' WHEN 3 THEN '' ELSE NULL END AS gender,
       r_name AS country,
       n_name AS state,
       concat('City_', CAST(c_custkey % 37 AS STRING)) AS city,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE DATE '1960-01-01' + CAST((c_custkey * 37) % 21000 AS INT) END AS date_of_birth,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE concat('Grade ', CAST(c_custkey % 17 AS STRING)) END AS designation,
       CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 10 = 3 THEN NULL ELSE c_mktsegment END AS occupation,
       c_custkey % 3 = 0 AS prior_cohort
FROM customer
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey % 13 <> 5
""",
    "bookings": """
SELECT email, form_name, name, time_slot, time_slot_range, created_at
FROM (
  SELECT concat('user', CAST(o_custkey AS STRING), '@example.com') AS email,
         CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 29 = 0 THEN 'Feedback Form'
              ELSE concat('Workshop ', substr(o_orderpriority, 1, 1)) END AS form_name,
         concat('Member ', CAST(o_custkey AS STRING)) AS name,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL
              ELSE CAST(DATE '2024-11-20' + CAST(o_orderkey % 5 AS INT) AS TIMESTAMP) END AS time_slot,
         CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(20 + o_orderkey % 5 AS STRING), ' Nov, 4:00 - 7:00 PM')
              WHEN o_orderkey % 3 = 1 THEN '' ELSE NULL END AS time_slot_range,
         o_orderdate AS created_at,
         row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn
  FROM orders) x
WHERE rn = 1
""",
    "submissions": """
SELECT workshop_name, email, name, project_link, valid, team_id, likes, comments, created_at
FROM (
  SELECT concat('Workshop ', CAST(l_linenumber AS STRING)) AS workshop_name,
         concat('user', CAST(l_partkey AS STRING), '@example.com') AS email,
         concat('Member ', CAST(l_partkey AS STRING)) AS name,
         CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
              WHEN 2 THEN concat('https://elsewhere.example.net/p/', CAST(l_partkey AS STRING))
              ELSE concat('https://blog.example.org/p/', CAST(l_partkey AS STRING)) END AS project_link,
         CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false ELSE NULL END AS valid,
         concat('T', CAST(l_suppkey AS STRING)) AS team_id,
         CAST(floor(l_quantity) AS INT) AS likes,
         CAST(round(l_discount * 100) AS INT) AS comments,
         l_shipdate AS created_at,
         row_number() OVER (PARTITION BY l_linenumber, l_partkey
           ORDER BY l_orderkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag) AS rn
  FROM lineitem) x
WHERE rn = 1
""",
    "weekly": """
SELECT week_number, email, github_link, blog_link, valid, likes, comments, github_valid, created_at
FROM (
  SELECT CAST(floor((day(ts) - 1) / 7) AS INT) + 1 AS week_number,
         concat('user', CAST(user_id AS STRING), '@example.com') AS email,
         CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN ''
              ELSE concat('https://github.com/user', CAST(user_id AS STRING), '/repo', CAST(event_id % 50 AS STRING)) END AS github_link,
         CASE event_type WHEN 'signup' THEN NULL WHEN 'click' THEN ''
              ELSE concat('https://blog.example.org/w/', CAST(event_id AS STRING)) END AS blog_link,
         CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN NULL ELSE false END AS valid,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END AS likes,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS comments,
         CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN false ELSE true END AS github_valid,
         ts AS created_at,
         row_number() OVER (PARTITION BY floor((day(ts) - 1) / 7), user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) x
WHERE rn = 1
""",
    "labs": """
SELECT workshop_name, email, name, problem_statement, proof_link, valid, assigned_to, assigned_at, remarks, created_at
FROM (
  SELECT concat('Workshop ', substr(o_orderpriority, 1, 1)) AS workshop_name,
         concat('user', CAST(o_custkey AS STRING), '@example.com') AS email,
         concat('Member ', CAST(o_custkey AS STRING)) AS name,
         concat('Problem ', CAST(o_orderkey % 12 AS STRING)) AS problem_statement,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('https://proof.example.org/', CAST(o_orderkey AS STRING)) END AS proof_link,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE NULL END AS valid,
         concat('Reviewer ', CAST(o_orderkey % 6 AS STRING)) AS assigned_to,
         o_orderdate AS assigned_at,
         CASE WHEN o_orderkey % 5 = 0 THEN 'Needs rework' ELSE NULL END AS remarks,
         o_orderdate AS created_at,
         row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rn
  FROM orders) x
WHERE rn = 1
""",
    "change_log": """
SELECT event_id AS log_id,
       CASE user_id % 4 WHEN 0 THEN 'participants' WHEN 1 THEN 'bookings' WHEN 2 THEN 'submissions' ELSE 'weekly' END AS table_name,
       CASE event_id % 5 WHEN 0 THEN 'INSERT' WHEN 4 THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
       concat('user', CAST(user_id AS STRING), '@example.com') AS record_identifier,
       props AS new_values,
       ts AS log_ts
FROM events
""",
    "access_users": """
SELECT s_suppkey AS user_id, s_name AS username, s_suppkey % 25 = 0 AS is_admin, s_acctbal > 0 AS is_active
FROM supplier
""",
    "access_permissions": """
SELECT p_partkey AS permission_id, concat('route_', CAST(p_partkey AS STRING)) AS route_name, p_name AS display_name,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS category
FROM part
""",
    "access_grants": """
SELECT DISTINCT l_suppkey AS user_id, l_partkey AS permission_id
FROM lineitem
""",
    "linked_pages": """
SELECT page_id, url,
       concat(CASE WHEN page_id % 17 = 0 THEN '<title>404 Not Found</title>' ELSE '' END, html,
              CASE WHEN page_id % 4 = 0 THEN ''
                   ELSE concat('<button aria-label="Like this article"><span class="_card-action-text_a1">', CAST(page_id % 40 AS STRING),
                               '</span></button><button aria-label="Comment on this article"><span>', CAST(page_id % 9 AS STRING), '</span></button>') END) AS html
FROM pages
""",
    "repo_entries": """
SELECT concat('https://github.com/user', CAST(user_id AS STRING), '/repo', CAST(event_id % 50 AS STRING)) AS repo_url,
       CASE event_id % 4 WHEN 0 THEN '.marker' WHEN 1 THEN 'src' WHEN 2 THEN 'README.md' ELSE 'docs' END AS entry_name,
       CASE event_id % 4 WHEN 2 THEN 'file' ELSE 'dir' END AS entry_type
FROM events
""",
    "raw_rows": """
SELECT c_custkey AS row_number_in_file,
       CASE c_custkey % 7 WHEN 0 THEN concat('  USER', CAST(c_custkey AS STRING), '@Example.com ')
                          WHEN 1 THEN concat('user', CAST(c_custkey AS STRING)) WHEN 2 THEN '' WHEN 3 THEN NULL
                          ELSE concat('user', CAST(c_custkey % 400 AS STRING), '@example.com') END AS email,
       CASE c_custkey % 8 WHEN 0 THEN '   ' ELSE concat(' ', c_name, ' ') END AS name,
       CASE c_custkey % 3 WHEN 0 THEN concat('+91 98765-', CAST(10000 + c_custkey AS STRING)) WHEN 1 THEN '12345' ELSE NULL END AS phone,
       CASE c_custkey % 5 WHEN 0 THEN '2025-09-12T11:52:26.894Z' WHEN 1 THEN '01/02/2024' WHEN 2 THEN '25 Nov 2024 14:00'
                          WHEN 3 THEN 'soon' ELSE '2024-01-05 10:00' END AS created_text,
       CASE c_custkey % 4 WHEN 0 THEN '25 Nov, 4:00 - 7:00 PM' WHEN 1 THEN '26 Nov, 10:00 AM - 1:00 PM' WHEN 2 THEN '' ELSE 'tbd' END AS slot_text,
       CASE c_custkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN '0' WHEN 3 THEN 'on' WHEN 4 THEN NULL ELSE 'No' END AS flag_text,
       CASE c_custkey % 4 WHEN 0 THEN 'B.Tech 2024' WHEN 1 THEN '2023' WHEN 2 THEN 'N/A' ELSE NULL END AS degree_text
FROM customer
""",
}



def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixture views as CTEs (in the given order)."""
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n].strip()}\n)" for n in names)
    return f"WITH {ctes}\n{sql.strip()}"
