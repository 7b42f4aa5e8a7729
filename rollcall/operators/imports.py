"""Import of messy rows: blank drop, typing, required fields, reject split,
default fill and summaries (C12-C16, C20, C21).

An import batch is a DataFrame of string cells with a ``row_number`` column
(header = 1, data from 2).  ``generic_import`` follows the generic table
import: fields typed by name, required fields checked, then the e-mail.
Rejected rows come out as a second frame with a ``Row n: reason`` message;
nothing is ever collected per batch except the capped error list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import cleaning as C
from rollcall.functions import messages as MSG

# Required fields per target table.
REQUIRED_FIELDS = {
    "participants": ["email", "name"],
    "bookings": ["email", "form_name", "name"],
    "team_building": ["workshop_name", "email", "name"],
    "submissions": ["workshop_name", "email", "name"],
    "verification": ["workshop_name", "email", "name"],
}
ERROR_CAP = 100     # error messages in a summary of the generic import; no default of this module


def non_blank(cols: list[str]) -> Column:
    """True when some cell is non-empty (a row of only null/'' cells is
    skipped silently; whitespace counts as content, as in the source)."""
    return F.greatest(*[F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in cols]) if len(cols) > 1 \
        else F.coalesce(F.col(cols[0]).cast("string"), F.lit("")) != ""


def drop_blank_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.filter(non_blank(cols))


def missing_fields(required: list[str]) -> Column:
    """C14: comma-separated names of required fields that are null or empty."""
    flags = [F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in required]
    return F.concat_ws(", ", *flags)


def reject_reason(required: list[str], email_col: str = "email") -> Column:
    """First failing check, in order missing -> invalid e-mail."""
    missing = missing_fields(required)
    has_email = F.col(email_col).isNotNull() & (F.col(email_col) != "")
    return (F.when(missing != "", F.concat(F.lit(MSG.MISSING_REQUIRED_FIELDS), missing))
            .when(has_email & ~C.is_valid_email(email_col), F.concat(F.lit(MSG.INVALID_EMAIL), F.col(email_col))))


def split_rejects(df: DataFrame, required: list[str], row_col: str = "row_number",
                  email_col: str = "email", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  Accepted rows get the e-mail key
    lower-cased and stripped (C2); rejects carry ``Row n: reason``."""
    tagged = df.withColumn("__reason", reject_reason(required, email_col))
    accepted = (tagged.filter(F.col("__reason").isNull()).drop("__reason")
                .withColumn(email_col, F.when(F.col(email_col).isNotNull(), C.normalize_email(email_col))))
    rejected = tagged.filter(F.col("__reason").isNotNull()).select(
        *keep, F.col(row_col).alias("row_number"),
        MSG.row_error(row_col, F.col("__reason")).alias("error"))
    return accepted, rejected


def fill_defaults(df: DataFrame, columns: list[str], run_ts: str) -> DataFrame:
    """Null timestamps default to the run time (a parameter, not now())."""
    ts = F.lit(run_ts).cast("timestamp_ntz")
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c), ts))
    return df


def generic_import(batch: DataFrame, table: str, mappings: dict[str, str], year: int, run_ts: str,
                   row_col: str = "row_number", defaults: list[str] | None = None,
                   constants: dict[str, object] | None = None,
                   keep: tuple[str, ...] = (), materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """E2 composition: drop blank rows, type mapped fields by name (C11), add
    constants (H6), check required fields and e-mail (C14/C15), fill defaults
    (C16).  ``keep`` columns (e.g. file and sheet) pass through.
    ``materialize`` deals the rows over all tasks and writes the typed batch
    once (reliable checkpoint in the shared checkpoint folder) when records,
    rejects and a summary will all read it, instead of re-running the parsers
    for each.  Returns (records,
    rejects)."""
    cells = [c for c in batch.columns if c != row_col and c not in keep]
    rows = drop_blank_rows(batch, cells)
    if materialize:
        from rollcall.session import spread
        rows = spread(rows, *keep, row_col)
    typed = C.with_types_by_name(rows, mappings, year).select(*keep, row_col, *mappings.keys())
    for k, v in (constants or {}).items():
        typed = typed.withColumn(k, F.lit(v))
    if materialize:
        from rollcall.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(typed.sparkSession)
        typed = typed.checkpoint(eager=True)
    accepted, rejected = split_rejects(typed, REQUIRED_FIELDS.get(table, []), row_col, keep=keep)
    if defaults:
        accepted = fill_defaults(accepted, defaults, run_ts)
    return accepted, rejected


def import_summary(batch_rows: DataFrame, outcome: DataFrame, rejected: DataFrame,
                   cap: int | None = None) -> DataFrame:
    """C20: rows read, created, updated, skipped and error count in one row.

    ``outcome`` is a merge outcome: per key, ``inserted`` (0/1) and
    ``updated`` (records) counts.  The messages themselves are ``rejected``,
    one row each.  With ``cap`` the first so many (by file, sheet and row
    where those columns exist) are added as a list, the only list here."""
    zero = F.lit(0).cast("long")
    place = [c for c in ("path", "sheet_index", "row_number") if c in rejected.columns]
    none_e = F.lit(None).cast(T.StructType([rejected.schema[c] for c in (*place, "error")]))
    tagged = (batch_rows.select(F.lit("row").alias("k"), zero.alias("ins"), zero.alias("upd"), none_e.alias("e"))
              .unionByName(outcome.select(F.lit("out").alias("k"), F.col("inserted").cast("long").alias("ins"),
                                          F.col("updated").cast("long").alias("upd"), none_e.alias("e")))
              .unionByName(rejected.select(F.lit("rej").alias("k"), zero.alias("ins"), zero.alias("upd"),
                                           none_e.alias("e"))))
    counts = [F.count_if(F.col("k") == "row").alias("rows"), F.sum("ins").alias("created"), F.sum("upd").alias("updated"),
              F.count_if(F.col("k") == "rej").alias("skipped"), F.count_if(F.col("k") == "rej").alias("error_count")]
    if not cap:
        return tagged.agg(*counts)
    first = rejected.orderBy(*place, "error").limit(cap).select(
        F.lit("err").alias("k"), zero.alias("ins"), zero.alias("upd"), F.struct(*place, "error").alias("e"))
    return tagged.unionByName(first).agg(
        *counts, F.transform(F.array_sort(F.collect_list("e")), lambda x: x["error"]).alias("errors"))


def import_report(batch_rows: DataFrame, outcome: DataFrame, rejected: DataFrame) -> DataFrame:
    """C20 whole: the row of counts, and every error message with its place as a row of its own (its counts are null)."""
    place = [c for c in ("path", "sheet_index", "row_number") if c in rejected.columns]
    return import_summary(batch_rows, outcome, rejected).unionByName(
        rejected.select(*place, "error"), allowMissingColumns=True)


def file_summary(batch: DataFrame, table: str, mappings: dict[str, str], year: int, row_col: str = "row_number",
                 by: tuple[str, ...] = ("path", "sheet_index"), email_col: str = "email") -> DataFrame:
    """C20 per file and sheet: rows read, blank rows, accepted rows, and skipped
    rows by reason, from one pass over the batch."""
    cells = [c for c in batch.columns if c != row_col and c not in by]
    typed = C.with_types_by_name(batch.withColumn("__blank", ~non_blank(cells)), mappings, year)
    tagged = typed.withColumn("__missing", missing_fields(REQUIRED_FIELDS.get(table, [])) != "") \
        .withColumn("__reason", reject_reason(REQUIRED_FIELDS.get(table, []), email_col))
    bad = ~F.col("__blank") & F.col("__reason").isNotNull()
    return tagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("__blank").alias("blank"),
        F.count_if(~F.col("__blank") & F.col("__reason").isNull()).alias("accepted"),
        F.count_if(bad & F.col("__missing")).alias("missing_fields"),
        F.count_if(bad & ~F.col("__missing")).alias("invalid_email"))


def workbook_summary(applied: DataFrame) -> DataFrame:
    """Per sheet rows read / inserted / updated and the distinct
    workshops processed, plus a grand-total row (one rollup).  ``applied``
    has one row per applied record: (sheet_index, workshop_name, inserted,
    updated) with the record's insert/update counts from its merge."""
    per_sheet = (applied.rollup("sheet_index")
                 .agg(F.count(F.lit(1)).alias("rows_read"),
                      F.sum("inserted").cast("long").alias("inserted"),
                      F.sum("updated").cast("long").alias("updated"),
                      F.count_distinct("workshop_name").alias("workshops"),
                      (F.grouping("sheet_index") == 1).alias("is_total")))
    return per_sheet.orderBy("is_total", "sheet_index")


def generic_import_rows(rows: DataFrame, table: str, mapping: dict[str, str], year: int, run_ts: str,
                        defaults: list[str] | None = None, constants: dict[str, object] | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """The generic table import over file rows (row shape from
    ``sources``): fields mapped by header name (first column with that
    name), then ``generic_import``.  Rejects keep their file and sheet."""
    from rollcall.operators import headers as H
    from rollcall.sources.rows import data_rows, materialized_headers
    positions = H.positions_for_names(materialized_headers(rows), mapping)
    fields = [f for f, name in mapping.items() if name]
    mapped = H.apply_mapping(data_rows(rows), positions, fields)
    batch = mapped.select("path", "sheet_index", "row_number", *fields)
    records, rejected = generic_import(batch, table, {f: f for f in fields}, year, run_ts,
                                       defaults=defaults, constants=constants, keep=("path", "sheet_index"))
    return records, rejected
