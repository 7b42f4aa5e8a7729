"""Header validation, lookup, auto-mapping and mapping application (H2-H6).

All work runs on the header table ``(path, sheet_index, position, header)``
(``sources.rows.headers``).  Field and pattern lists are small fixed
constants, so every check is an aggregate expression per constant (no join
with a pattern table); the result is one row per sheet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.joins import checked_broadcast
from rollcall.functions import messages as MSG

SHEET = ["path", "sheet_index"]
# per-sheet tables up to this many rows are broadcast (after a count check)
SHEETS_BOUND = 100_000

# Expected column counts and critical headers per sheet kind.
EXPECTED_COLUMNS = {"form": 15, "project": 14}
CRITICAL_HEADERS = {
    "form": ["Email", "Name", "Team Name"],
    "project": ["Email", "Name", "Team Name", "AWS Builder Center Blog Link"],
}
# The header texts of the form and project sheets.
FORM_HEADERS = [
    "Team Name", "Leader Name", "Leader Email", "Leader Phone", "Team Size", "Problem Statements", "Name", "Email",
    "Book your slot for workshop 1 - Building a Simple Content Summarizer with Amazon Bedrock", "Created At", "Created By Name",
    "Created By Email", "Updated At", "Updated By Name", "Updated By Email"]
PROJECT_HEADERS = [
    "Team Name", "Leader Name", "Leader Email", "Leader Phone", "Team Size", "Problem Statements",
    "Hands-on Lab Completion Proof", "AWS Builder Center Blog Link", "Created At", "Created By Name", "Created By Email",
    "Updated At", "Updated By Name", "Updated By Email"]
# Header search terms per field (first header containing any).
FORM_FIELDS = {
    "name": ["Name"], "email": ["Email"], "team_name": ["Team Name", "TeamName"],
    "time_slot": ["Book your slot", "time slot", "Time Slot"],
    "created_at": ["Created At", "CreatedAt"], "updated_at": ["Updated At", "UpdatedAt"],
}
PROJECT_FIELDS = {
    "name": ["Name"], "email": ["Email"], "team_name": ["Team Name", "TeamName"],
    "project_link": ["AWS Builder Center Blog Link", "Blog Link", "Project Link"],
    "created_at": ["Created At", "CreatedAt"], "updated_at": ["Updated At", "UpdatedAt"],
}
PARTICIPANT_FIELDS = {
    "email": ["Email", "email"], "name": ["Name", "name"], "phone_number": ["Phone", "phone", "Phone Number"],
    "gender": ["Gender", "gender"], "country": ["Country", "country"], "state": ["State", "state"],
    "city": ["City", "city"], "date_of_birth": ["Date of Birth", "DOB", "dob", "Birth Date"],
    "designation": ["Designation", "designation"], "class_stream": ["Class", "Stream", "Class/Stream"],
    "degree_passout_year": ["Degree", "Passout Year", "Passout"], "occupation": ["Occupation", "occupation"],
    "linkedin": ["LinkedIn", "linkedin", "LinkedIn URL"], "participated_in_academy_1_0": ["Academy", "Participated"],
    "registration_date_time": ["Registration", "Registration Date"],
}
# Weekly-sheet fields in mapping order with their patterns.
WEEKLY_PATTERNS = [
    ("email", ["email", "leader email", "user email", "e-mail", "e mail", "mail", "email address", "email id"]),
    ("github_link", ["github", "github link", "github repository", "repo", "repository", "github repo", "git",
                     "github url"]),
    ("blog_link", ["blog", "blog link", "aws builder", "builder center", "blog url", "blog post", "article",
                   "technical blog"]),
    ("created_at", ["created", "created at", "created date", "date created", "created on", "created time",
                    "submitted at", "submitted date"]),
    ("updated_at", ["updated", "updated at", "updated date", "date updated", "modified", "modified at",
                    "modified date", "last updated", "last modified"]),
]


def _contains_ci(header: Column, term: str) -> Column:
    return F.lower(header).contains(term.lower())


def validate_headers(headers: DataFrame, kind: str) -> DataFrame:
    """H2: per sheet, the list of header errors (empty = valid): too few
    columns, and each critical header that is no case-insensitive substring
    of any header."""
    expected = EXPECTED_COLUMNS[kind]
    aggs = [F.count(F.lit(1)).alias("n_columns")]
    crit = CRITICAL_HEADERS[kind]
    for i, c in enumerate(crit):
        aggs.append(F.bool_or(_contains_ci(F.col("header"), c)).alias(f"__c{i}"))
    g = headers.groupBy(*SHEET).agg(*aggs)
    errors = [F.when(F.col("n_columns") < expected,
                     F.format_string(MSG.TOO_FEW_COLUMNS.format(expected=expected), F.col("n_columns")))]
    errors += [F.when(~F.col(f"__c{i}"), F.lit(MSG.MISSING_CRITICAL_HEADER + c)) for i, c in enumerate(crit)]
    return g.select(*SHEET, "n_columns", F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"))


def lookup_columns(headers: DataFrame, fields: dict[str, list[str]], prefer_exact: bool = False) -> DataFrame:
    """H3: per sheet and field, the first header position containing any of
    the field's terms (case-insensitive); null when none.

    By default this keeps the source behaviour, where ``Name`` finds ``Team
    Name`` before ``Name``.  ``prefer_exact`` first takes a header equal to a
    term (case-insensitive, trimmed) and falls back to the substring rule."""
    aggs = []
    for f, terms in fields.items():
        pred = reduce(lambda a, b: a | b, [_contains_ci(F.col("header"), t) for t in terms])
        first = F.min(F.when(pred, F.col("position")))
        if prefer_exact:
            exact = F.lower(F.trim(F.col("header"))).isin([t.lower() for t in terms])
            first = F.coalesce(F.min(F.when(exact, F.col("position"))), first)
        aggs.append(first.alias(f))
    return headers.groupBy(*SHEET).agg(*aggs)


def _normalize(header: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(header)), r"[^a-z0-9\s]", "")


def auto_map_best_pattern(headers: DataFrame, patterns: list[tuple[str, list[str]]] = WEEKLY_PATTERNS) -> DataFrame:
    """H4: greedy auto-map.  Field by field in the given order, the unused
    header with the longest contained pattern wins; ties keep the first
    header (its first occurrence).  Headers are used up by name.  One
    aggregate plus one anti-join per field (a fixed, short unrolled
    sequence); returns (path, sheet_index, field, position, header)."""
    norm = headers.select(*SHEET, "position", "header", _normalize(F.col("header")).alias("__n"))
    used = None
    picks = []
    for field, pats in patterns:
        score = F.greatest(*[F.when(F.col("__n").contains(p), F.lit(len(p))).otherwise(F.lit(0)) for p in pats])
        # headers are marked used by name (a repeated name is used up at once)
        cand = norm if used is None else norm.join(used, SHEET + ["header"], "left_anti")
        best = (cand.withColumn("__s", score).filter(F.col("__s") > 0)
                .groupBy(*SHEET).agg(F.max_by(F.struct("position", "header"),
                                              F.struct(F.col("__s"), -F.col("position"))).alias("b"))
                .select(*SHEET, F.lit(field).alias("field"), "b.position", "b.header"))
        picks.append(best)
        chosen = best.select(*SHEET, "header")
        used = chosen if used is None else used.unionByName(chosen)
    return reduce(lambda a, b: a.unionByName(b), picks)


def auto_map_similar(headers: DataFrame, fields: list[str], lab_variant: bool = False) -> DataFrame:
    """H5: name-similarity auto-map; the *last* matching header wins (and a
    repeated name maps to its first column).
    A header matches when the field contains the header with spaces as ``_``
    or the header contains the field (lab variant also compares the field
    with ``_`` as spaces)."""
    h = F.lower(F.col("header"))
    # one row per sheet and header name; whether it matches depends on the name alone, so the last matching column of a sheet is
    # the last column of some name, and the chosen name maps to its first column, as a name lookup does
    names = headers.filter(F.col("path").isNotNull() & F.col("sheet_index").isNotNull()).groupBy(*SHEET, "header").agg(
        F.min("position").alias("first"), F.max("position").alias("last"))
    picks = []
    for f in fields:
        fl = f.lower()
        pred = F.lit(fl).contains(F.regexp_replace(h, r"\s+", "_")) | h.contains(fl)
        if lab_variant:
            spaced = fl.replace("_", " ")
            pred = pred | F.lit(spaced).contains(h) | h.contains(spaced)
        picks.append(F.max_by("first", F.when(pred, F.col("last"))).alias(f"__{len(picks)}"))
    wide = names.groupBy(*SHEET).agg(*picks)
    found = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{i}").alias("position")) for i, f in enumerate(fields)])
    return wide.select(*SHEET, F.inline(found)).filter(F.col("position").isNotNull())


def apply_mapping(rows: DataFrame, mapping: DataFrame, fields: list[str],
                  constants: dict[str, object] | None = None) -> DataFrame:
    """H6: project each data row to ``fields`` using a per-sheet mapping
    (wide: one position column per field); a short row or an unmapped field
    gives null; constants are added as literals.  Rows of a typed workbook
    scan keep what each field's cell holds in the struct ``kinds``."""
    # one mapping row per sheet: broadcast after a size check, so a sheet with
    # a third of all rows is not funnelled through one join partition
    j = rows.join(checked_broadcast(mapping, SHEETS_BOUND), SHEET, "inner")
    cols = [F.when(F.col(f).isNotNull(), F.try_element_at(F.col("cells"), F.col(f) + 1)).alias(f)
            for f in fields]
    if "kinds" in rows.columns:
        cols.append(F.struct(*[F.when(F.col(f).isNotNull(), F.try_element_at(F.col("kinds"), F.col(f) + 1)).alias(f)
                               for f in fields]).alias("kinds"))
    out = j.select(*SHEET, "sheet_name", "row_number", "cells", *cols)
    for k, v in (constants or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out


def positions_for_names(headers: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """H6 (generic import): ``{field: header name}`` to one row per sheet with
    the first column carrying that exact name; names not in the sheet give
    null (the field is skipped)."""
    aggs = [F.min(F.when(F.col("header") == name, F.col("position"))).alias(field)
            for field, name in mapping.items() if name]
    return headers.groupBy(*SHEET).agg(*aggs)


def pivot_mapping(long_mapping: DataFrame, fields: list[str]) -> DataFrame:
    """(path, sheet_index, field, position) -> one row per sheet, a position
    column per field (the pivot values are the fixed field list)."""
    return long_mapping.groupBy(*SHEET).pivot("field", fields).agg(F.first("position"))
