"""Oracle SQL (DuckDB dialect) for link-validation queries."""

from __future__ import annotations

from rollcall.plans.fixture_sql import with_views as W


def _text(html: str) -> str:
    t = f"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{ent}', '{ch}')"
    return t


def _button(html: str, label: str) -> str:
    return (f"regexp_extract({html}, '(?is)<button\\b[^>]*aria-label\\s*=\\s*\"[^\"]*{label}[^\"]*\"[^>]*>(.*?)</button>', 1)")


def _has_button(html: str, label: str) -> str:
    return f"regexp_matches({html}, '(?is)<button\\b[^>]*aria-label\\s*=\\s*\"[^\"]*{label}[^\"]*\"')"


def _spans(block: str, cls: bool) -> str:
    c = "[^>]*class\\s*=\\s*\"[^\"]*_card-action-text[^\"]*\"" if cls else ""
    return (f"list_transform(regexp_extract_all({block}, '(?is)<span\\b{c}[^>]*>(.*?)</span>', 1), "
            f"lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')))")


def _counter(html: str, label: str, rendered: bool = False) -> str:
    block = _button(html, label)
    action = _spans(block, True)
    anys = _spans(block, False)
    first_digit_any = f"list_filter({anys}, lambda x: regexp_matches(x, '^[0-9]+$'))[1]"
    if rendered:
        value = f"COALESCE(list_filter({action}, lambda x: regexp_matches(x, '^[0-9]+$'))[1], {first_digit_any})"
    else:
        value = (f"CASE WHEN len({action}) > 0 THEN CASE WHEN regexp_matches({action}[1], '^[0-9]+$') "
                 f"THEN {action}[1] END ELSE {first_digit_any} END")
    return f"CASE WHEN {_has_button(html, label)} THEN COALESCE(CAST({value} AS INTEGER), 0) ELSE 0 END"


def _missing_plain(html: str, window: int | None = None) -> str:
    text = f"lower({_text(html)})"
    text = f"substr({text}, 1, {window})" if window else text
    return f"COALESCE(contains({text}, '404') OR contains({text}, 'not found'), false)"


def _missing_rendered(html: str, window: int | None = None) -> str:
    title = f"lower(regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1))"
    src = f"lower({html})"
    seen = f"substr({src}, 1, {window})" if window else src
    return (f"COALESCE(contains({title}, '404') OR contains({title}, 'not found') OR contains({seen}, '404') "
            f"OR contains({src}, 'page you''re looking for can''t be found') "
            f"OR contains({src}, 'the page you''re looking for can''t be found'), false)")


PAGES = """
fetched AS (SELECT 'https://blog.example.org/p/' || CAST(page_id AS VARCHAR) AS link, html, 200 AS status
            FROM linked_pages)"""

SIGNALS = f"""
signals AS (SELECT link, {_missing_plain('html')} AS missing,
                   {_counter('html', 'like this article')} AS page_likes,
                   {_counter('html', 'comment on this article')} AS page_comments
            FROM fetched)"""

VERDICTS = f"""
verdicts AS (
  SELECT s.workshop_name, s.email, s.project_link AS link,
         CASE WHEN NOT contains(s.project_link, 'blog.example.org') THEN false
              WHEN g.link IS NOT NULL AND g.missing THEN false ELSE true END AS valid,
         CASE WHEN NOT contains(s.project_link, 'blog.example.org') THEN 'Invalid Domain'
              WHEN g.link IS NULL THEN 'Verified but Page not fetched'
              WHEN g.missing THEN '404 Not Found' ELSE 'Verified' END AS reason,
         CAST(CASE WHEN contains(s.project_link, 'blog.example.org') AND g.link IS NOT NULL AND NOT g.missing
                   THEN g.page_likes ELSE 0 END AS INTEGER) AS likes,
         CAST(CASE WHEN contains(s.project_link, 'blog.example.org') AND g.link IS NOT NULL AND NOT g.missing
                   THEN g.page_comments ELSE 0 END AS INTEGER) AS comments
  FROM submissions s LEFT JOIN signals g ON s.project_link = g.link
  WHERE s.project_link IS NOT NULL AND s.project_link <> '')"""

REPO_PATH = "regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _repo_key(u: str) -> str:
    norm = f"CASE WHEN starts_with(trim({u}), 'http') THEN trim({u}) ELSE 'https://' || trim({u}) END"
    parts = f"list_filter(string_split({REPO_PATH.format(u=norm)}, '/'), lambda x: x <> '')"
    fixed = (f"list_transform({parts}, lambda x, i: CASE WHEN i = len({parts}) THEN regexp_replace(x, '\\.git$', '') "
             f"ELSE x END)")
    return f"CASE WHEN len({parts}) >= 2 THEN lower(array_to_string({fixed}[1:2], '/')) END"


MIXED = f"""
got AS (
  SELECT 'https://blog.example.org/w/' || CAST(page_id AS VARCHAR) AS blog_link, page_id % 5 = 1 AS broken,
         page_id % 13 = 4 AS late, page_id % 7 = 3 AS huge, page_id % 11 = 2 AS gone,
         COALESCE(contains(lower({_text('html')}), '404') OR contains(lower({_text('html')}), 'not found'), false) AS said,
         {_counter('html', 'like this article')} AS n_likes, {_counter('html', 'comment on this article')} AS n_comments
  FROM linked_pages),
seen AS (
  SELECT blog_link, CASE WHEN late THEN 'Request timeout' WHEN broken THEN 'Request error: 500' END AS trouble,
         NOT broken AND gone OR said AS lost, CASE WHEN huge THEN 0 ELSE n_likes END AS n_likes, n_comments
  FROM got),
checked AS (
  SELECT week_number, email, w.blog_link AS link, trouble IS NOT NULL OR lost IS NOT TRUE AS valid,
         CASE WHEN s.blog_link IS NULL THEN 'Verified but Page not fetched'
              WHEN trouble IS NOT NULL THEN 'Verified but ' || trouble
              WHEN lost THEN '404 Not Found' ELSE 'Verified' END AS reason,
         CAST(CASE WHEN trouble IS NULL AND lost = false THEN n_likes ELSE 0 END AS INTEGER) AS likes,
         CAST(CASE WHEN trouble IS NULL AND lost = false THEN n_comments ELSE 0 END AS INTEGER) AS comments
  FROM weekly w LEFT JOIN seen s ON w.blog_link = s.blog_link WHERE length(w.blog_link) > 0)"""

REPO_STATUS = f"""
fetched AS (
  SELECT 'user' || CAST(user_id AS VARCHAR) || '/repo' || CAST(event_id % 50 AS VARCHAR) AS rk, min(event_id) % 9 AS k
  FROM events GROUP BY 1),
trouble AS (
  SELECT rk, CASE k WHEN 1 THEN 'Repository not found (404)' WHEN 2 THEN 'Rate limit exceeded. Please wait and try again later'
                    WHEN 3 THEN 'Rate limit exceeded.' WHEN 4 THEN 'Repository access forbidden (may be private)'
                    WHEN 5 THEN 'GitHub API error: 500 - server error' END AS said
  FROM fetched),
listing AS (
  SELECT {_repo_key('repo_url')} AS rk, min(entry_name) FILTER (entry_type = 'dir' AND starts_with(entry_name, '.marker')) AS m,
         string_agg(DISTINCT entry_name, ', ' ORDER BY entry_name) FILTER (entry_type = 'dir') AS names
  FROM repo_entries GROUP BY 1),
judged AS (
  SELECT w.week_number, w.email, w.github_link AS link, w.rk IS NOT NULL AND said IS NULL AND m IS NOT NULL AS github_valid,
         CASE WHEN w.rk IS NULL THEN 'Invalid GitHub URL format. Expected owner/repo, got: ' || w.github_link
              WHEN said IS NOT NULL THEN said
              WHEN l.rk IS NULL THEN 'Repository not found (404)'
              WHEN m IS NOT NULL THEN 'Valid - Found folder: ' || m
              WHEN names IS NOT NULL THEN 'Invalid - No folder starting with ''.marker'' found. Available folders: ' || names
              ELSE 'Invalid - No folders found in repository root' END AS github_validation_reason
  FROM (SELECT *, {_repo_key('github_link')} AS rk FROM weekly WHERE length(github_link) > 0) w
  LEFT JOIN listing l ON w.rk = l.rk LEFT JOIN trouble t ON w.rk = t.rk)"""

RUN = """
counted AS (
  SELECT *, row_number() OVER o AS current, COUNT(*) OVER () AS total,
         CAST(SUM(CASE WHEN valid THEN 1 ELSE 0 END) OVER o AS BIGINT) AS validated,
         CAST(SUM(CASE WHEN NOT valid THEN 1 ELSE 0 END) OVER o AS BIGINT) AS failed,
         CAST(SUM(CASE WHEN valid AND (likes > 0 OR comments > 0) THEN 1 ELSE 0 END) OVER o AS BIGINT) AS updated
  FROM verdicts WINDOW o AS (ORDER BY workshop_name, email ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
run AS (
  SELECT *, 'Processed ' || current || '/' || total || ': ' || link || CASE WHEN valid AND (likes > 0 OR comments > 0)
            THEN printf('... (Likes: %d, Comments: %d)', likes, comments) ELSE '... (' || reason || ')' END AS status
  FROM counted)"""

ORACLE = {
    "v4_weekly_link_verdicts": W(f", {MIXED}\nSELECT * FROM checked", "linked_pages", "weekly"),
    "v5_weekly_refreshed": W(f""", {MIXED}
SELECT t.week_number, t.email, CASE WHEN link IS NULL THEN t.valid ELSE c.valid END AS valid,
       CASE WHEN link IS NULL THEN t.likes ELSE c.likes END AS likes,
       CASE WHEN link IS NULL THEN t.comments ELSE c.comments END AS comments, reason AS validation_reason
FROM weekly t LEFT JOIN checked c ON t.week_number = c.week_number AND t.email = c.email""", "linked_pages", "weekly"),
    "v8_repo_status_verdicts": W(f", {REPO_STATUS}\nSELECT * FROM judged", "weekly", "repo_entries"),
    "v5_weekly_repositories": W(f""", {REPO_STATUS}
SELECT t.week_number, t.email, CASE WHEN link IS NULL THEN t.github_valid ELSE c.github_valid END AS github_valid,
       c.github_validation_reason
FROM weekly t LEFT JOIN judged c ON t.week_number = c.week_number AND t.email = c.email""", "weekly", "repo_entries"),
    "v1_v3_page_signals": W(f""", {PAGES}, {SIGNALS}
SELECT link, missing, page_likes, page_comments, contains(link, 'blog.example.org') AS allowed FROM signals""",
                            "linked_pages"),
    "v2_missing_page_rendered": W(f"""
SELECT page_id, {_missing_rendered('html')} AS missing,
       {_counter('html', 'like this article', True)} AS likes,
       {_counter('html', 'comment on this article', True)} AS comments
FROM linked_pages""", "linked_pages"),
    "v2_missing_page_reference_window": W(f"""
SELECT page_id, {_missing_plain('html', 1000)} AS plain, {_missing_rendered('html', 2000)} AS rendered FROM linked_pages""",
                                          "linked_pages"),
    "v4_link_verdicts": W(f", {PAGES}, {SIGNALS}, {VERDICTS}\nSELECT * FROM verdicts", "linked_pages", "submissions"),
    "v5_refreshed_submissions": W(f""", {PAGES}, {SIGNALS}, {VERDICTS}
SELECT t.workshop_name, t.email, t.name, t.project_link,
       CASE WHEN v.email IS NOT NULL THEN v.valid ELSE t.valid END AS valid,
       t.team_id,
       CASE WHEN v.email IS NOT NULL THEN v.likes ELSE t.likes END AS likes,
       CASE WHEN v.email IS NOT NULL THEN v.comments ELSE t.comments END AS comments,
       t.created_at,
       v.reason AS validation_reason
FROM submissions t LEFT JOIN verdicts v ON t.workshop_name = v.workshop_name AND t.email = v.email""",
                                  "linked_pages", "submissions"),
    "v6_repo_url_parts": W(f"""
SELECT week_number, email,
       list_filter(string_split({REPO_PATH.format(u='github_link')}, '/'), lambda x: x <> '')[1] AS owner,
       regexp_replace(list_filter(string_split({REPO_PATH.format(u='github_link')}, '/'), lambda x: x <> '')[2],
                      CASE WHEN len(list_filter(string_split({REPO_PATH.format(u='github_link')}, '/'), lambda x: x <> '')) = 2
                           THEN '\\.git$' ELSE '$^' END, '') AS repo
FROM weekly WHERE github_link IS NOT NULL AND github_link <> ''""", "weekly"),
    "v7_marker_folder_check": W(f""",
ent AS (SELECT {_repo_key('repo_url')} AS rk, entry_name, entry_type FROM repo_entries),
listed AS (SELECT DISTINCT rk FROM ent WHERE rk IS NOT NULL),
dirs AS (SELECT DISTINCT rk, entry_name FROM ent WHERE rk IS NOT NULL AND entry_type = 'dir'),
marker AS (SELECT rk, min(entry_name) AS m FROM dirs WHERE starts_with(entry_name, '.marker') GROUP BY rk),
firstdirs AS (SELECT rk, string_agg(entry_name, ', ' ORDER BY entry_name) AS names FROM dirs GROUP BY rk),
w AS (SELECT week_number, email, github_link, {_repo_key('github_link')} AS rk FROM weekly
      WHERE github_link IS NOT NULL AND github_link <> '')
SELECT w.week_number, w.email, w.github_link AS link,
       w.rk IS NOT NULL AND l.rk IS NOT NULL AND m.m IS NOT NULL AS github_valid,
       CASE WHEN w.rk IS NULL THEN 'Invalid GitHub URL format. Expected owner/repo, got: ' || w.github_link
            WHEN l.rk IS NULL THEN 'Repository not found (404)'
            WHEN m.m IS NOT NULL THEN 'Valid - Found folder: ' || m.m
            WHEN f.names IS NOT NULL THEN 'Invalid - No folder starting with ''.marker'' found. Available folders: ' || f.names
            ELSE 'Invalid - No folders found in repository root' END AS github_validation_reason
FROM w LEFT JOIN listed l ON w.rk = l.rk LEFT JOIN marker m ON w.rk = m.rk LEFT JOIN firstdirs f ON w.rk = f.rk""",
                                "weekly", "repo_entries"),
    "v9_run_totals": W(f""", {PAGES}, {SIGNALS}, {VERDICTS}
SELECT COUNT(CASE WHEN valid THEN 1 END) AS validated, COUNT(CASE WHEN NOT valid THEN 1 END) AS failed,
       COUNT(CASE WHEN valid AND (likes > 0 OR comments > 0) THEN 1 END) AS updated
FROM verdicts""", "linked_pages", "submissions"),
    "v10_progress_trail": W(f""", {PAGES}, {SIGNALS}, {VERDICTS}, {RUN}
SELECT workshop_name, email, current, total, validated, failed, updated, status FROM run""", "linked_pages", "submissions"),
    "v11_pattern_counters": W("""
SELECT page_id,
       CAST(regexp_extract_all(html, '(?i)(?:like|likes?)[":\\s]*(\\d+)', 1)[1] AS INTEGER) AS likes,
       CAST(regexp_extract_all(html, '(?i)(?:comment|comments?)[":\\s]*(\\d+)', 1)[1] AS INTEGER) AS comments
FROM linked_pages""", "linked_pages"),
}
