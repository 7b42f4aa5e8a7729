"""Change log: capture (L1, L2) and the log queries.

Capture compares the before and after images of a table (or consumes the
output of a merge) and emits one row per inserted, updated or deleted record
with JSON images.  The log queries are filter + sort + limit; the log is meant
to be stored partitioned by ``table_name`` so table filters prune files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import ensure_checkpoint_dir

DEFAULT_PAGE = 100

# Record-identifier parts per table, in the reference's order.
# ``null_safe`` tables render missing parts as the text NULL.
IDENTIFIER_KEYS = {
    "participants": (["email"], False),
    "bookings": (["email", "form_name"], False),
    "team_building": (["workshop_name", "email"], False),
    "submissions": (["workshop_name", "email"], False),
    "verification": (["workshop_name", "email"], False),
    "weekly": (["week_number", "email"], True),
    "labs": (["workshop_name", "email"], False),
}


def record_identifier(table: str, side: str | None = None, keys: list[str] | None = None) -> Column:
    """L2: key columns joined with ``|``.  Ordinary tables use a
    null-propagating concat; the weekly table renders nulls as ``NULL``; an
    empty or missing identifier becomes ``<table>|unknown``.  Tables outside
    the programme use their given ``keys``."""
    keys, null_safe = IDENTIFIER_KEYS.get(table, (keys or [], False))

    def c(k):
        col = F.col(f"{side}.{k}" if side else k).cast("string")
        return F.coalesce(col, F.lit("NULL")) if null_safe else col

    parts = []
    for i, k in enumerate(keys):
        if i:
            parts.append(F.lit("|"))
        parts.append(c(k))
    ident = F.concat(*parts)
    return F.coalesce(F.when(ident != "", ident), F.lit(f"{table}|unknown"))


def _image(df_alias: str | None, columns: list[str]) -> Column:
    ref = (lambda c: F.col(f"{df_alias}.{c}")) if df_alias else F.col
    return F.to_json(F.struct(*[ref(c).alias(c) for c in columns]),
                     {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})


def capture_changes(before: DataFrame, after: DataFrame, table: str, keys: list[str], run_ts: str,
                    touched: DataFrame | None = None) -> DataFrame:
    """L1: change rows between two states of a keyed table.

    Full outer join on the key: only-after = INSERT, only-before = DELETE,
    both = UPDATE.  With ``touched`` (the keys a merge updated) every touched
    row is logged as UPDATE even when no value differs, like a row trigger;
    without it, only rows whose image differs are.  The identifier comes
    from the surviving side."""
    cols = [c for c in after.columns]
    b = before.select(*cols, F.lit(True).alias("__in_before")).alias("b")
    a = after.select(*cols, F.lit(True).alias("__in_after")).alias("a")
    if touched is not None:
        a = after.join(touched.select(*keys).distinct().withColumn("__touched", F.lit(True)), keys, "left") \
            .select(*cols, F.lit(True).alias("__in_after"), "__touched").alias("a")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    j = a.join(b, cond, "full_outer")
    in_a, in_b = F.col("a.__in_after").isNotNull(), F.col("b.__in_before").isNotNull()
    op = F.when(in_a & in_b, "UPDATE").when(in_a, "INSERT").otherwise("DELETE")
    out = j.select(
        F.lit(table).alias("table_name"),
        op.alias("operation_type"),
        F.when(in_a, record_identifier(table, "a", keys)).otherwise(record_identifier(table, "b", keys))
        .alias("record_identifier"),
        F.when(in_b, _image("b", cols)).alias("old_values"),
        F.when(in_a, _image("a", cols)).alias("new_values"),
        F.lit(run_ts).cast("timestamp_ntz").alias("log_ts"),
        (F.when(in_a & in_b, F.col("a.__touched").isNotNull() if touched is not None
                else _image("a", cols) != _image("b", cols)).otherwise(F.lit(True))).alias("__logged"),
    )
    return out.filter(F.col("__logged")).drop("__logged")


def change_rows(applied: DataFrame, table: str, columns: list[str], keys: list[str], run_ts: str) -> DataFrame:
    """Change rows from a merge's applied frame: new values in ``columns``,
    the old image in the ``__old`` struct, the operation in ``__op``."""
    old = F.to_json(F.col("__old"), {"ignoreNullFields": "false",
                                     "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})
    return applied.select(
        F.lit(table).alias("table_name"),
        F.col("__op").alias("operation_type"),
        record_identifier(table, None, keys).alias("record_identifier"),
        F.when(F.col("__op") == "UPDATE", old).alias("old_values"),
        _image(None, columns).alias("new_values"),
        F.lit(run_ts).cast("timestamp_ntz").alias("log_ts"),
    )


def statement_log(target: DataFrame, batch: DataFrame, table: str, keys: list[str], run_ts: str, *,
                  order_col: str = "row_number", overwrite: list[str] | None = None, keep_existing: tuple[str, ...] = (),
                  coalesce: tuple[str, ...] = (), defaults: dict[str, Column] | None = None,
                  insert_defaults_ts: tuple[str, ...] = (), touch_col: str | None = "updated_at",
                  created_col: str | None = "created_at") -> DataFrame:
    """L1 as a row trigger writes it: one change row per record of an upsert,
    each with the image before and after that record (the options are those
    of ``merge.merge_keyed``; the result has ``order_col`` besides).

    A record is a partial update, and updates compose: an overwritten column
    has the value of the latest record, a kept or coalesced one the latest
    value that isn't null.  Records are ranged over the tasks by key and
    order, so a key with a third of all records lies in many chunks.  Each chunk
    is composed to one row, a prefix over the few chunks of a key gives
    what stands before each, and within its chunk a record sees what came
    before it by a window.  ``order_col`` orders the records of a key.
    """
    ensure_checkpoint_dir(batch.sparkSession)
    carried = [c for c in (*coalesce, *keep_existing)]
    columns = [c for c in batch.columns if c not in keys and c != order_col]
    overwrite = [c for c in (overwrite if overwrite is not None else columns) if c in columns]
    held = [c for c in target.columns if c in overwrite and c in carried]
    # both the chunks' rows and the windows read the partition ids, so they are written down once
    ranged = batch.repartitionByRange(*keys, order_col).withColumn("__chunk", F.spark_partition_id()).checkpoint(eager=True)
    record = F.struct(*columns)

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order_col)))

    chunks = ranged.groupBy(*keys, "__chunk").agg(F.max_by(record, order_col).alias("__rec"), *[latest(c).alias(f"__nn_{c}") for c in held])
    before_chunk = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*keys, "__chunk", F.last("__rec").over(before_chunk).alias("__c_rec"),
                          *[F.last(f"__nn_{c}", ignorenulls=True).over(before_chunk).alias(f"__c_{c}") for c in held])
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order_col)
    earlier, up_to = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(
        "*", F.lag(record).over(inside).alias("__l_rec"),
        *[F.last(c, ignorenulls=True).over(w).alias(f"__{n}_{c}") for c in held for n, w in (("b", earlier), ("u", up_to))])
    stored = target.select(*keys, F.struct(*target.columns).alias("__t"))
    j = local.join(carry, [*keys, "__chunk"]).join(stored, keys, "left")
    j = j.withColumn("__p", F.coalesce("__l_rec", "__c_rec")).withColumn("__new", F.col("__t").isNull())
    ts, first = F.lit(run_ts).cast("timestamp_ntz"), F.col("__p").isNull()

    def image(value, latest_name: str, is_first: Column) -> Column:
        """The row after the record whose values ``value`` gives; ``latest_name`` has the latest values up to it."""
        out = []
        for c in target.columns:
            old, inserted = F.col(f"__t.{c}"), F.when(F.col("__new"), (defaults or {}).get(c, F.lit(None)))
            if c in keys:
                v = F.col(c)
            elif c in held:
                v = F.coalesce(F.col(f"__{latest_name}_{c}"), F.col(f"__c_{c}"), old)
                if c in insert_defaults_ts:
                    v = F.coalesce(v, F.when(F.col("__new"), ts))
            elif c == touch_col:
                v = ts
            elif c in overwrite:
                v = value(c)
                if c == created_col or c in insert_defaults_ts:
                    v = F.when(F.col("__new") & is_first, F.coalesce(v, ts)).otherwise(v)
            elif c == created_col or c in insert_defaults_ts:
                v = F.coalesce(old, F.when(F.col("__new"), ts))
            else:
                v = F.coalesce(old, inserted)
            out.append(v.cast(target.schema[c].dataType).alias(c))
        return F.struct(*out)

    # whether the record before was the first of its key matters only where a new row takes a default it then loses
    after = image(F.col, "u", first)
    was_first = F.col("__l_rec").isNotNull() & F.lag(F.lit(1), 2).over(inside).isNull() & F.col("__c_rec").isNull() \
        if set(overwrite) & {created_col, *insert_defaults_ts} - set(held) else F.lit(False)
    before = image(lambda c: F.col(f"__p.{c}"), "b", was_first)
    rows = j.select(*keys, order_col, F.when(first & F.col("__new"), F.lit("INSERT")).otherwise(F.lit("UPDATE")).alias("__op"),
                    F.when(first, F.col("__t")).otherwise(before).alias("__old"), after.alias("__after"))
    text = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
    return rows.select(
        F.lit(table).alias("table_name"), F.col("__op").alias("operation_type"), record_identifier(table, None, keys).alias("record_identifier"),
        F.when(F.col("__op") == "UPDATE", F.to_json("__old", text)).alias("old_values"), F.to_json("__after", text).alias("new_values"),
        ts.alias("log_ts"), order_col)


def deletion_row(table: str, keys: list[str], columns: list[str], row: str, run_ts: str) -> Column:
    """The DELETE change row of the row in struct column ``row``."""
    return F.struct(
        F.lit(table).alias("table_name"), F.lit("DELETE").alias("operation_type"),
        record_identifier(table, row, keys).alias("record_identifier"), _image(row, columns).alias("old_values"),
        F.lit(None).cast("string").alias("new_values"), F.lit(run_ts).cast("timestamp_ntz").alias("log_ts"))


def deletion_rows(deleted: DataFrame, table: str, keys: list[str], run_ts: str) -> DataFrame:
    """DELETE change rows for rows known to be deleted (old image only);
    no join with the remaining table is needed."""
    return deleted.select(
        F.lit(table).alias("table_name"),
        F.lit("DELETE").alias("operation_type"),
        record_identifier(table, None, keys).alias("record_identifier"),
        _image(None, deleted.columns).alias("old_values"),
        F.lit(None).cast("string").alias("new_values"),
        F.lit(run_ts).cast("timestamp_ntz").alias("log_ts"),
    )


def update_rows(rows: DataFrame, table: str, keys: list[str], run_ts: str) -> DataFrame:
    """UPDATE change rows: ``rows`` holds the new values plus the previous
    image in an ``__old`` struct; the identifier comes from the new values."""
    cols = [c for c in rows.columns if c != "__old"]
    old = F.to_json(F.col("__old"), {"ignoreNullFields": "false",
                                     "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})
    return rows.select(
        F.lit(table).alias("table_name"),
        F.lit("UPDATE").alias("operation_type"),
        record_identifier(table, None, keys).alias("record_identifier"),
        old.alias("old_values"),
        _image(None, cols).alias("new_values"),
        F.lit(run_ts).cast("timestamp_ntz").alias("log_ts"),
    )


# ---------------------------------------------------------------- L3-L8
def newest_first(df: DataFrame) -> DataFrame:
    """The order of every log listing: latest time first (none counts as latest), then the highest id."""
    return df.orderBy(F.col("log_ts").desc_nulls_first(), F.col("log_id").desc())


def log_page(log: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """L3: newest first, one page (``offset`` rows skipped)."""
    out = newest_first(log)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def log_by_table(log: DataFrame, table: str, limit: int = DEFAULT_PAGE) -> DataFrame:
    """L4"""
    return newest_first(log.filter(F.col("table_name") == table)).limit(limit)


def log_by_operation(log: DataFrame, operation: str, limit: int = DEFAULT_PAGE) -> DataFrame:
    """L5"""
    return newest_first(log.filter(F.col("operation_type") == operation)).limit(limit)


def log_by_time(log: DataFrame, start: str, end: str, limit: int = DEFAULT_PAGE) -> DataFrame:
    """Inclusive time range."""
    ts = F.col("log_ts")
    return newest_first(log.filter(ts.between(F.lit(start).cast("timestamp_ntz"),
                                         F.lit(end).cast("timestamp_ntz")))).limit(limit)


def record_history(log: DataFrame, table: str, identifier: str) -> DataFrame:
    """Every entry of one record, newest first, no limit."""
    return newest_first(log.filter((F.col("table_name") == table) & (F.col("record_identifier") == identifier)))


def log_query(log: DataFrame, table: str | None = None, operation: str | None = None,
              limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """A table filter wins over an operation filter (never combined)."""
    if table:
        return log_by_table(log, table, limit)
    if operation:
        return log_by_operation(log, operation, limit)
    return log_page(log, limit, offset)
