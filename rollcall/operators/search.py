"""Search, filter, sort, facets and counts over tables (Q1-Q6).

The reference does these in the browser over fetched rows; here each is a
predicate or sort on the DataFrame, so filters are pushed to the scan where
possible and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Search columns of the three searchable listings.
PARTICIPANT_SEARCH_COLUMNS = ["email", "name", "phone_number", "country"]
SUBMISSION_SEARCH_COLUMNS = ["workshop_name", "email", "name", "project_link"]
LAB_SEARCH_COLUMNS = ["email", "name", "problem_statement", "remarks"]


def searchable_text(columns: list[str]) -> Column:
    """Lower-cased, space-joined text of ``columns`` (null -> '').

    ``concat_ws`` alone would drop nulls and shift the separators, so every
    column is coalesced first."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def search_predicate(columns: list[str], term: str | None, trim: bool = True) -> Column:
    t = (term or "").lower()
    if trim:
        t = t.strip()
    if not t:
        return F.lit(True)
    return searchable_text(columns).contains(F.lit(t))


def search(df: DataFrame, columns: list[str], term: str | None, trim: bool = True) -> DataFrame:
    """Q1: rows whose searchable text contains the term; empty term = all."""
    return df.filter(search_predicate(columns, term, trim))


def status_workshop_predicate(status: str = "all", workshop: str = "all", valid_col: str = "valid",
                              workshop_col: str = "workshop_name") -> Column:
    """Q2: status valid / invalid (= not valid, nulls included) / all, and a
    case-insensitive workshop equality."""
    pred = F.lit(True)
    if status == "valid":
        pred = pred & F.coalesce(F.col(valid_col), F.lit(False))
    elif status == "invalid":
        pred = pred & ~F.coalesce(F.col(valid_col), F.lit(False))
    if workshop and workshop != "all":
        pred = pred & (F.lower(F.coalesce(F.col(workshop_col), F.lit(""))) == workshop.lower())
    return pred


def filter_submissions(df: DataFrame, term: str | None = None, status: str = "all",
                       workshop: str = "all") -> DataFrame:
    return df.filter(search_predicate(SUBMISSION_SEARCH_COLUMNS, term) & status_workshop_predicate(status, workshop))


# Sortable fields and whether they compare as text or number.
SORT_FIELDS = {
    "workshop_name": "text", "email": "text", "name": "text",
    "created_at": "number", "likes": "number", "comments": "number",
}


def dynamic_sort(df: DataFrame, field: str, direction: str = "asc", collation: str | None = None,
                 tiebreak: list[str] | None = None) -> DataFrame:
    """Q3: sort by a chosen field.  Text compares with nulls as '' (optionally
    under a collation such as ``UNICODE``); numbers with nulls as 0.  Unknown
    fields keep the input order.  ``tiebreak`` columns make the order total; rows
    that are equal in all of these follow a hash of the row (``spread``)."""
    if field not in SORT_FIELDS:
        return df
    key = sort_key(field, collation)
    key = key.desc() if direction == "desc" else key.asc()
    return df.orderBy(key, *[F.col(c).asc() for c in (tiebreak or [])], spread(df))


def sort_key(field: str, collation: str | None = None) -> Column:
    """The value that a field of ``SORT_FIELDS`` is sorted by."""
    if SORT_FIELDS[field] == "text":
        key = F.coalesce(F.col(field), F.lit(""))
        if field == "workshop_name":
            key = F.lower(key)
        if collation:
            key = F.collate(key, collation)
    elif field == "created_at":
        key = F.coalesce(F.unix_micros(F.col(field).cast("timestamp")), F.lit(0))
    else:
        key = F.coalesce(F.col(field), F.lit(0))
    return key


def spread(df: DataFrame) -> Column:
    """Last sort key that tells rows of one sort value apart, so that a value
    that many rows share is ranged over several tasks instead of one."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def workshop_facets(df: DataFrame, col: str = "workshop_name") -> DataFrame:
    """Q4: distinct lower-cased non-empty workshop names, sorted."""
    w = F.lower(F.col(col))
    return df.select(w.alias("workshop")).filter(F.col("workshop").isNotNull() & (F.col("workshop") != "")) \
        .distinct().orderBy("workshop")


def result_count(df: DataFrame, predicate: Column) -> DataFrame:
    """Q5: visible and total rows in one pass."""
    return df.agg(F.count_if(predicate).alias("visible"), F.count(F.lit(1)).alias("total"))


def newest_first(df: DataFrame, col: str = "created_at") -> DataFrame:
    """Q6: listing ordered by creation time, newest first; rows of one time follow a hash of the row."""
    return df.orderBy(F.col(col).desc_nulls_first(), spread(df))
