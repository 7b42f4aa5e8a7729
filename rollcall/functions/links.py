"""Column expressions for link validation.

Pages and repository listings arrive as tables (fetching stays outside Spark);
these expressions read them with built-in regex functions, so the HTML is
scanned inside codegen'd projections, once per page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.labels import col_

# Allowed blog domains, the domain served as a rendered page,
# phrases of a missing page and the counter markup.
ALLOWED_DOMAINS = ["community.aws", "builder.aws.com"]
RENDERED_DOMAINS = ["builder.aws.com"]
MISSING_PHRASES = ["page you're looking for can't be found", "the page you're looking for can't be found"]
# (the windows are the source system's; the functions read whole pages unless one is passed)
PLAIN_TEXT_WINDOW = 1000
RENDERED_SOURCE_WINDOW = 2000
LIKE_LABEL = "like this article"
COMMENT_LABEL = "comment on this article"
ACTION_CLASS = "_card-action-text"
MARKER_PREFIX = ".kiro"
# V11 pattern counters (script/text scan).
LIKE_PATTERN = r'(?i)(?:like|likes?)[":\s]*(\d+)'
COMMENT_PATTERN = r'(?i)(?:comment|comments?)[":\s]*(\d+)'

_DIGITS = r"^[0-9]+$"


def allowed_domain(link, domains: list[str] = ALLOWED_DOMAINS) -> Column:
    """V1: the link *contains* one of the allowed domains."""
    c = col_(link)
    pred = F.lit(False)
    for d in domains:
        pred = pred | c.contains(d)
    return pred


def visible_text(html) -> Column:
    """Text of a page: comments and tags removed, common entities decoded."""
    t = F.regexp_replace(col_(html), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def page_title(html) -> Column:
    return F.regexp_extract(col_(html), r"(?is)<title[^>]*>(.*?)</title>", 1)


def missing_page_plain(html, status=None, window: int | None = None) -> Column:
    """V2 (plain fetch): status 404, or ``404`` / ``not found`` in the page
    text (in its first ``window`` characters, where given)."""
    text = visible_text(html)
    head = F.lower(F.substring(text, 1, window) if window else text)
    pred = head.contains("404") | head.contains("not found")
    if status is not None:
        pred = (col_(status) == 404) | pred
    return F.coalesce(pred, F.lit(False))


def missing_page_rendered(html, window: int | None = None) -> Column:
    """V2 (rendered page): ``404``/``not found`` in the title, ``404`` in the
    source (in its first ``window`` characters, where given), or a
    can't-be-found phrase."""
    src = F.lower(col_(html))
    title = F.lower(page_title(html))
    pred = title.contains("404") | title.contains("not found") | \
        (F.substring(src, 1, window) if window else src).contains("404")
    for p in MISSING_PHRASES:
        pred = pred | src.contains(p)
    return F.coalesce(pred, F.lit(False))


def _button_block(html, label: str) -> Column:
    pat = r'(?is)<button\b[^>]*aria-label\s*=\s*"[^"]*' + label + r'[^"]*"[^>]*>(.*?)</button>'
    return F.regexp_extract(col_(html), pat, 1)


def _has_button(html, label: str) -> Column:
    return col_(html).rlike(r'(?is)<button\b[^>]*aria-label\s*=\s*"[^"]*' + label + r'[^"]*"')


def _span_texts(block: Column, class_part: str | None = None) -> Column:
    cls = r'[^>]*class\s*=\s*"[^"]*' + class_part + r'[^"]*"' if class_part else ""
    spans = F.regexp_extract_all(block, F.lit(r"(?is)<span\b" + cls + r"[^>]*>(.*?)</span>"), F.lit(1))
    return F.transform(spans, lambda s: F.trim(F.regexp_replace(s, r"<[^>]*>", "")))


def counter(html, label: str, rendered: bool = False) -> Column:
    """V3: number shown in the button with aria-label ``label``.

    Plain page: the first ``_card-action-text`` span decides (digits -> value,
    otherwise 0, no fallback); without such a span the first all-digit span
    of the button.  Rendered page: the first all-digit action span, else the
    first all-digit span.  No button -> 0."""
    block = _button_block(html, label)
    action = _span_texts(block, ACTION_CLASS)
    anyspan = _span_texts(block)
    # a run of digits that no int holds reads as 0
    first_digit_any = F.try_element_at(F.filter(anyspan, lambda s: s.rlike(_DIGITS)), F.lit(1))
    if rendered:
        first_digit_action = F.try_element_at(F.filter(action, lambda s: s.rlike(_DIGITS)), F.lit(1))
        value = F.coalesce(first_digit_action, first_digit_any)
    else:
        first_action = F.try_element_at(action, F.lit(1))
        value = F.when(F.size(action) > 0, F.when(first_action.rlike(_DIGITS), first_action)) \
            .otherwise(first_digit_any)
    return F.when(_has_button(html, label), F.coalesce(value.try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def pattern_counter(text, pattern: str = LIKE_PATTERN) -> Column:
    """First number following a like/comment word in page text or scripts;
    null without one, and for a run of digits that no int holds."""
    hits = F.regexp_extract_all(col_(text), F.lit(pattern), F.lit(1))
    return F.try_element_at(hits, F.lit(1)).try_cast("int")


# ---------------------------------------------------------------- V6
def repo_path_parts(url) -> Column:
    """V6: ``[owner, repo]`` of a repository URL, or null for a bad format.

    Strip, add ``https://`` when missing, take the URL path, split on ``/``
    dropping empties, cut ``.git`` from the last part, keep the first two.
    Written with regex extraction only (no array lambdas), so it stays in
    generated code."""
    path = F.coalesce(F.try_parse_url(normalized_repo_url(url), F.lit("PATH")), F.lit(""))
    owner = F.regexp_extract(path, r"^/*([^/]+)", 1)
    second = F.regexp_extract(path, r"^/*[^/]+/+([^/]+)", 1)
    more = path.rlike(r"^/*[^/]+/+[^/]+/+[^/]")
    repo = F.when(more, second).otherwise(F.regexp_replace(second, r"\.git$", ""))
    return F.when((owner != "") & (second != ""), F.array(owner, repo))


def normalized_repo_url(url) -> Column:
    """The URL after the strip / scheme step (used in messages)."""
    u = F.regexp_replace(col_(url), r"(?U)^\s+|\s+$", "")
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))
