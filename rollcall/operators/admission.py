"""Admission of import records and what became of each of them (K1-K4 on import, C20, C21).

The source system writes records one by one, and what the database refuses
becomes a ``Row n:`` error of that record while the others go on.  Here the
checks that a record meets alone - column widths, required columns, the
reference to its parent - are made for all records at once before the merge,
and the outcome of the merge is brought back to single records, so that
rows, created, updated, skipped and errors of every file and sheet add up to
the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import messages as MSG
from rollcall.operators import imports as IM
from rollcall.operators import merge as M
from rollcall.schemas import FOREIGN_KEY, NOT_NULL, PRIMARY_KEYS, WIDTHS

CREATED, UPDATED, UNCHANGED = "created", "updated", "unchanged"


def _first_of(reasons: list[Column]) -> Column:
    return F.coalesce(*reasons, F.lit(None).cast("string")) if reasons else F.lit(None).cast("string")


def refusal(columns: list[str], table: str) -> Column:
    """K3/K4: why the table refuses the record's own values: the first over-wide value, then the first missing one."""
    wide = [F.when(F.length(c) > n, F.lit(MSG.VALUE_TOO_LONG.format(width=n))) for c, n in WIDTHS.get(table, {}).items() if c in columns]
    empty = [F.when(F.col(c).isNull(), F.lit(MSG.NULL_VALUE.format(column=c))) for c in NOT_NULL.get(table, []) if c in columns]
    return _first_of([*wide, *empty])


def admit(records: DataFrame, table: str, parent: DataFrame | None = None, row_col: str = "row_number",
          keep: tuple[str, ...] = (), fk: str = FOREIGN_KEY) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): records whose values fit their columns and whose
    reference exists in ``parent``, and ``Row n:`` errors of the others with
    the ``keep`` columns."""
    tagged = records.withColumn("__why", refusal(records.columns, table))
    if parent is not None:
        known = parent.select(F.col(fk)).distinct().withColumn("__known", F.lit(True))
        tagged = tagged.join(known, fk, "left")
        orphan = F.when(F.col("__known").isNull(), F.lit(MSG.NO_PARENT.format(table=table)))
        tagged = tagged.withColumn("__why", F.coalesce("__why", orphan)).drop("__known")
    admitted = tagged.filter(F.col("__why").isNull()).select(*records.columns)
    rejected = tagged.filter(F.col("__why").isNotNull()).select(
        *keep, F.col(row_col).alias("row_number"), MSG.row_error(row_col, F.col("__why")).alias("error"))
    return admitted, rejected


def key_clashes(result: M.MergeResult, table: str, row_col: str = "row_number") -> DataFrame:
    """K1: records of a merge on match fields whose key another row holds, as ``Row n:`` errors."""
    why = F.lit(MSG.DUPLICATE_KEY.format(table=table))
    return result.rejected.select(F.col(row_col).alias("row_number"), MSG.row_error(row_col, why).alias("error"))


def record_outcomes(records: DataFrame, target: DataFrame, keys: list[str], mode: str, order_col: str) -> DataFrame:
    """The records with ``fate``: created (the first record in file order of a
    key that the target lacks), updated, or unchanged (the mode has no use
    for it).

    Keys are reduced to their first record before the target is asked, and
    the answer is joined back to the records; the records of a hot key share
    one row of that table, so AQE can split them.
    """
    if mode not in M.MODES:
        raise ValueError(f"mode must be one of {M.MODES}")
    firsts = records.groupBy(*keys).agg(F.min(order_col).alias("__first"))
    stored = target.select(*keys).distinct().withColumn("__stored", F.lit(True))
    known = firsts.join(stored, keys, "left").select(*keys, "__first", F.col("__stored").isNotNull().alias("__stored"))
    fresh = ~F.col("__stored") & (F.col("__first") == F.col(order_col))
    fate = F.lit(UNCHANGED)
    if mode == "update":
        fate = F.when(F.col("__stored"), F.lit(UPDATED)).otherwise(fate)
    else:
        fate = F.when(fresh, F.lit(CREATED)).otherwise(F.lit(UPDATED) if mode == "upsert" else fate)
    return records.join(known, keys).select(*records.columns, fate.alias("fate"))


@dataclass
class Import:
    """Everything one import leaves behind."""

    merged: M.MergeResult
    outcomes: DataFrame     # admitted records with their fate
    rejected: DataFrame     # file, sheet, row_number, error
    by: tuple[str, ...]

    def summary(self) -> DataFrame:
        """C20 per file and sheet: rows (without blank ones), created, updated,
        unchanged, skipped; the parts add up to the rows."""
        fates = self.outcomes.select(*self.by, "fate").unionByName(self.rejected.select(*self.by, F.lit("skipped").alias("fate")))
        return fates.groupBy(*self.by).agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col("fate") == f).alias(f) for f in (CREATED, UPDATED, UNCHANGED, "skipped")])


def import_batch(batch: DataFrame, table: str, mappings: dict[str, str], target: DataFrame, year: int, run_ts: str,
                 mode: str = "upsert", by: tuple[str, ...] = ("path", "sheet_index"), row_col: str = "row_number",
                 parent: DataFrame | None = None, constants: dict[str, object] | None = None,
                 defaults: list[str] | None = None, keys: list[str] | None = None, **merge_options) -> Import:
    """Parse, admit and merge a batch that spans files and sheets; records apply in the order of ``by`` and row."""
    keys = keys or PRIMARY_KEYS[table]
    parsed, refused = IM.generic_import(batch, table, mappings, year, run_ts, row_col, defaults, constants, keep=by)
    admitted, rejected = admit(parsed, table, parent, row_col, by)
    ordered = admitted.withColumn("__order", F.struct(*by, row_col))
    merged = M.merge_keyed(target, ordered.drop(*by, row_col), keys, mode, run_ts=run_ts, order_col="__order", **merge_options)
    outcomes = record_outcomes(ordered, target, keys, mode, "__order").drop("__order")
    return Import(merged, outcomes, refused.unionByName(rejected), by)


def sheet_outcomes(outcomes: DataFrame, workshop_col: str) -> DataFrame:
    """Records with their fate in the form that ``imports.workbook_summary`` takes: one row per record."""
    return outcomes.select("sheet_index", F.col(workshop_col).alias("workshop_name"),
                           (F.col("fate") == CREATED).cast("long").alias("inserted"),
                           (F.col("fate") == UPDATED).cast("long").alias("updated"))
