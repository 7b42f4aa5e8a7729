"""Constraint checks and referential actions as queries (K1-K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """K1: keys held by more than one row, with their row count (the count is
    combined map-side, so a hot key costs one partial count per task)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, fk: str = "email", pk: str | None = None) -> DataFrame:
    """K2: child rows whose reference is missing in the parent (anti-join)."""
    p = parent.select(F.col(pk or fk).alias(fk)).distinct()
    return child.join(p, fk, "left_anti")


def accepted(child: DataFrame, parent: DataFrame, fk: str = "email", pk: str | None = None) -> DataFrame:
    """K2: child rows whose reference exists (semi-join)."""
    p = parent.select(F.col(pk or fk).alias(fk)).distinct()
    return child.join(p, fk, "left_semi")


def _per_column(df: DataFrame, table: str, preds: dict[str, object]) -> DataFrame:
    """One aggregate counting each predicate, unpivoted to (table, column, violations)."""
    if not preds:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, violations long")
    agg = df.agg(*[F.count_if(p).alias(c) for c, p in preds.items()])
    return (agg.unpivot([], list(preds), "column_name", "violations")
            .select(F.lit(table).alias("table_name"), "column_name", F.col("violations").cast("long")))


def not_null_violations(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """K3: null count per required column (absent columns are skipped)."""
    return _per_column(df, table, {c: F.col(c).isNull() for c in columns if c in df.columns})


def length_violations(df: DataFrame, table: str, widths: dict[str, int]) -> DataFrame:
    """K4: values longer than the column's width, per column."""
    return _per_column(df, table, {c: F.length(F.col(c)) > n for c, n in widths.items() if c in df.columns})


def _tagged(children: dict[str, DataFrame], fk: str) -> DataFrame:
    """All children as one relation: table, reference, and the row in a column of its table's own type."""
    parts = [df.select(F.lit(name).alias("table_name"), F.col(fk).alias("__fk"), F.struct(*df.columns).alias(f"r_{name}"))
             for name, df in children.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def split_by_deleted(children: dict[str, DataFrame], deleted: DataFrame, fk: str = "email") -> DataFrame:
    """K5: every child row with ``doomed``: whether its reference is deleted.
    The children are one relation that is keyed once and meets the deleted keys
    in one join, however many tables there are; kept and removed rows of each
    table are read from it."""
    keys = deleted.select(F.col(fk).alias("__fk")).distinct().withColumn("__gone", F.lit(True))
    return _tagged(children, fk).join(keys, "__fk", "left").withColumn("doomed", F.col("__gone").isNotNull()).drop("__fk", "__gone")


def rows_of(split: DataFrame, table: str) -> DataFrame:
    """The rows of one table in its own columns."""
    return split.filter(F.col("table_name") == table).select(f"r_{table}.*")


def cascade_delete(children: dict[str, DataFrame], deleted: DataFrame, fk: str = "email") -> dict[str, DataFrame]:
    """K5: the children without the rows that reference a deleted key."""
    kept = split_by_deleted(children, deleted, fk).filter("NOT doomed")
    return {name: rows_of(kept, name) for name in children}


def cascade_delete_logged(children: dict[str, DataFrame], deleted: DataFrame, keys: dict[str, list[str]],
                          run_ts: str, fk: str = "email") -> tuple[dict[str, DataFrame], DataFrame]:
    """K5 with its log: the remaining children and one DELETE change row per
    removed child row (like the per-row delete trigger).  Both come from
    the same split; images are made of removed rows only."""
    from rollcall.operators.changelog import deletion_row
    split = split_by_deleted(children, deleted, fk)
    kept, gone = split.filter("NOT doomed"), split.filter("doomed")
    rows = [F.when(F.col("table_name") == name, deletion_row(name, keys[name], df.columns, f"r_{name}", run_ts))
            for name, df in children.items()]
    log = gone.select(F.coalesce(*rows).alias("row")).select("row.*")
    return {name: rows_of(kept, name) for name in children}, log


def set_null_on_delete(df: DataFrame, deleted: DataFrame, col: str, pk: str) -> DataFrame:
    """K5, SET NULL variant (e.g. who granted a permission): references to a
    deleted key become null."""
    gone = deleted.select(F.col(pk).alias("__gone")).distinct().withColumn("__hit", F.lit(True))
    j = df.join(gone, df[col] == gone["__gone"], "left")
    return j.select(*[F.when(F.col("__hit").isNotNull(), F.lit(None)).otherwise(F.col(c)).alias(c)
                      if c == col else F.col(c) for c in df.columns])


def cascade_key_update(df: DataFrame, renames: DataFrame, col: str = "email", old: str = "old_email",
                       new: str = "new_email") -> DataFrame:
    """K6: rewrite references through an (old -> new) key map."""
    # one new key per old key (a conflicting map resolves to the smallest),
    # so a child row is never duplicated by the join
    m = renames.groupBy(F.col(old).alias("__old")).agg(F.min(new).alias("__new"))
    j = df.join(m, df[col] == m["__old"], "left")
    return j.select(*[F.coalesce(F.col("__new"), F.col(c)).alias(c) if c == col else F.col(c)
                      for c in df.columns])


def cascade_key_update_logged(df: DataFrame, renames: DataFrame, table: str, keys: list[str], run_ts: str,
                              col: str = "email", old: str = "old_email", new: str = "new_email"
                              ) -> tuple[DataFrame, DataFrame]:
    """K6 with its log: the rewritten table and one UPDATE change row per
    child row whose reference was renamed (old and new images)."""
    from rollcall.operators.changelog import update_rows
    m = renames.groupBy(F.col(old).alias("__from")).agg(F.min(new).alias("__to"))
    j = df.join(m, df[col] == m["__from"], "left")
    hit = F.col("__to").isNotNull()
    cols = [F.when(hit, F.col("__to")).otherwise(F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns]
    out = j.select(*cols)
    changed = j.filter(hit).select(*cols, F.struct(*[F.col(c) for c in df.columns]).alias("__old"))
    return out, update_rows(changed, table, keys, run_ts)
