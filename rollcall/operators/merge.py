"""Keyed merge of a batch into a table.

Parquet has no MERGE, so a merge is ``(target, batch) -> (state, outcome)``
computed with joins and written to a *new* version (``sinks.versioned``):

* the batch is first reduced to one record per key in file order (U11:
  upsert/update keep the last record, create the first; COALESCE columns keep
  the last non-null) with ``max_by``/``min_by`` aggregates - combined
  map-side, so a key holding a third of the batch is reduced before the
  shuffle;
* one full outer join of target and reduced batch produces the new state;
* ``outcome`` has per key the number of records that inserted and that
  updated, from which the counts follow (U12).

Match fields other than the key (U9/U10) are handled by splitting the batch by
which match fields are null and equi-joining each group on its non-null
fields, never by a non-equi or nested-loop join.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("upsert", "create", "update")


@dataclass
class MergeResult:
    state: DataFrame      # full new table
    outcome: DataFrame    # per key: inserted (0/1) and updated (records) counts
    before: DataFrame     # target as it was (for change capture)
    applied: DataFrame | None = None  # one row per target/batch key: new values, __old image, __op
    keys: tuple[str, ...] = ()
    run_ts: str | None = None
    rejected: DataFrame | None = None  # records that could not be inserted: their key exists already

    def counts(self) -> DataFrame:
        """inserted = records that created a row; updated = records that
        hit existing (or earlier-inserted) rows."""
        return self.outcome.agg(F.coalesce(F.sum("inserted"), F.lit(0)).cast("long").alias("inserted"),
                                F.coalesce(F.sum("updated"), F.lit(0)).cast("long").alias("updated"))

    def changes(self, table: str) -> DataFrame:
        """L1 straight from the merge join: one INSERT or UPDATE row per key
        the batch touched (an UPDATE even when no value changed, like a row
        trigger), with JSON images.  No second join of before and after."""
        from rollcall.operators.changelog import change_rows
        cols = self.before.columns
        a = self.applied.filter(F.col("__op").isNotNull())
        return change_rows(a, table, cols, list(self.keys), self.run_ts)


def _ts(run_ts: str) -> Column:
    return F.lit(run_ts).cast("timestamp_ntz")


def reduce_batch(batch: DataFrame, keys: list[str], order_col: str, keep: str = "last",
                 coalesce_cols: tuple[str, ...] = (), first_cols: tuple[str, ...] = ()) -> DataFrame:
    """One record per key in file order.  ``keep='last'`` (upsert/update)
    or ``'first'`` (create).  ``coalesce_cols`` take the last non-null value
    over the batch instead of the last record's value; ``first_cols`` the
    first record's value (e.g. the creation time of a key inserted and then
    updated within the batch)."""
    values = [c for c in batch.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    aggs = [pick(F.struct(*values), F.col(order_col)).alias("__rec"),
            F.count(F.lit(1)).alias("__n")]
    if first_cols:
        aggs.append(F.min_by(F.struct(*first_cols), F.col(order_col)).alias("__first"))
    for c in coalesce_cols:
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(f"__nn_{c}"))
    red = batch.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys]
    for v in values:
        if v in coalesce_cols:
            cols.append(F.col(f"__nn_{v}").alias(v))
        elif v in first_cols:
            cols.append(F.col(f"__first.{v}").alias(v))
        else:
            cols.append(F.col(f"__rec.{v}").alias(v))
    return red.select(*cols, "__n")


def merge_keyed(target: DataFrame, batch: DataFrame, keys: list[str], mode: str = "upsert", *,
                run_ts: str, order_col: str = "row_number", overwrite: list[str] | None = None,
                keep_existing: tuple[str, ...] = (), coalesce: tuple[str, ...] = (),
                defaults: dict[str, Column] | None = None, insert_defaults_ts: tuple[str, ...] = (),
                touch_col: str | None = "updated_at", created_col: str | None = "created_at",
                first_cols: tuple[str, ...] = ()) -> MergeResult:
    """Merge ``batch`` into ``target`` on ``keys``.

    * ``upsert`` (U1): matched rows take the batch values of ``overwrite``
      columns (nulls included), others keep theirs; new keys are inserted.
    * ``create`` (U2): only new keys are inserted, first record wins.
    * ``update`` (U3): only existing keys change.
    * ``keep_existing`` (U13): on update a null batch value keeps the stored one.
    * ``coalesce`` (U6): ``COALESCE(new, old)`` columns (null never overwrites).
    * ``insert_defaults_ts``: timestamp columns set to ``run_ts`` when a new
      row has none (registration time, created/updated).
    * ``touch_col`` (U14): set to ``run_ts`` on every updated row.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    tcols = target.columns
    bcols = [c for c in batch.columns if c != order_col]
    overwrite = overwrite if overwrite is not None else [c for c in bcols if c not in keys]
    # records apply one after another, so a keep-existing column ends with the
    # last non-null value of the batch (then the stored one), like COALESCE
    # (in create mode later records of a key are skipped: the first one wins)
    carry = () if mode == "create" else tuple(coalesce) + tuple(c for c in keep_existing if c not in coalesce)
    red = reduce_batch(batch, keys, order_col, "first" if mode == "create" else "last", carry, first_cols)
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = red.withColumn("__s", F.lit(True)).alias("s")
    how = {"upsert": "full_outer", "create": "full_outer", "update": "left"}[mode]
    j = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], how)
    in_t, in_s = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
    matched = in_t & in_s
    apply_update = matched if mode in ("upsert", "update") else F.lit(False)
    apply_insert = (~in_t & in_s) if mode in ("upsert", "create") else F.lit(False)
    ts = _ts(run_ts)
    out = []
    for c in tcols:
        tc = F.col(f"t.{c}")
        sc = F.col(f"s.{c}") if c in bcols else None
        if c in keys:
            out.append(F.coalesce(tc, F.col(f"s.{c}")).alias(c))
            continue
        if c == touch_col:
            upd = ts
        elif sc is None or c not in overwrite:
            upd = tc
        elif c in keep_existing or c in coalesce:
            upd = F.coalesce(sc, tc)
        else:
            upd = sc
        if c == created_col or c == touch_col or c in insert_defaults_ts:
            ins = F.coalesce(sc, ts) if sc is not None else ts
        elif sc is not None:
            ins = sc
        elif defaults and c in defaults:
            ins = defaults[c]
        else:
            ins = F.lit(None)
        out.append(F.when(apply_update, upd).when(apply_insert, ins).otherwise(tc).cast(target.schema[c].dataType)
                   .alias(c))
    keep_row = in_t | apply_insert
    op = F.when(apply_insert, F.lit("INSERT")).when(apply_update, F.lit("UPDATE"))
    applied = j.filter(keep_row).select(*out, F.struct(*[F.col(f"t.{c}").alias(c) for c in tcols]).alias("__old"),
                                        op.alias("__op"))
    state = applied.select(*tcols)
    # per key: the first record of a new key inserts, every other record of
    # the key counts as an update (mode permitting) - counts, not rows, so a
    # hot key never expands
    n = F.col("s.__n")
    outcome = j.filter(in_s).select(
        *[F.col(f"s.{k}").alias(k) for k in keys],
        F.when(apply_insert, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("inserted"),
        (F.when(apply_insert, n - 1).when(apply_update, n).otherwise(F.lit(0)) if mode != "create"
         else F.lit(0)).cast("long").alias("updated"))
    return MergeResult(state=state, outcome=outcome, before=target, applied=applied, keys=tuple(keys),
                       run_ts=run_ts)


def partial_update(target: DataFrame, updates: DataFrame, keys: list[str], *, run_ts: str,
                   touch_col: str | None = "updated_at", touch_from: str | None = None,
                   order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Only non-null supplied fields overwrite existing rows; a row with
    no supplied field is left alone and not counted.  ``touch_from`` (U5)
    names a supplied updated-at column; otherwise ``run_ts`` is used.
    Several updates of one key fold like updates applied one after another
    (per field the last non-null value), in the order of ``order_col``;
    without it in the order of their values, so the result is deterministic.
    Returns (state, counts)."""
    carried = [c for c in updates.columns if c not in keys and c != order_col]
    supplied = [c for c in carried if c != touch_from]
    has_field = F.greatest(*[F.col(c).isNotNull() for c in supplied]) if len(supplied) > 1 \
        else F.col(supplied[0]).isNotNull()
    order = order_col or "__order"
    if not order_col:
        updates = updates.withColumn(order, F.struct(*carried))
    # statements that set something, per key (each counts, as in a per-record update)
    flagged = updates.withColumn("__records", has_field.cast("long"))
    folded = flagged.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in carried],
        F.sum("__records").alias("__records"))
    updates = folded
    fields = [c for c in updates.columns if c not in keys and c != touch_from and c != "__records"]
    any_field = F.lit(False)
    for c in fields:
        any_field = any_field | F.col(f"u.{c}").isNotNull()
    u = updates.withColumn("__u", F.lit(True)).alias("u")
    j = target.alias("t").join(u, [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys], "left")
    hit = F.col("u.__u").isNotNull() & any_field
    touch = F.coalesce(F.col(f"u.{touch_from}"), _ts(run_ts)) if touch_from else _ts(run_ts)
    cols = []
    for c in target.columns:
        if c in fields:
            cols.append(F.when(hit, F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}")).alias(c))
        elif c == touch_col:
            cols.append(F.when(hit, touch).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"t.{c}").alias(c))
    state = j.select(*cols)
    counts = j.agg(F.coalesce(F.sum(F.when(hit, F.col("u.__records"))), F.lit(0)).cast("long").alias("updated"))
    return state, counts


def insert_or_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """U8: ``ON CONFLICT DO NOTHING``: new keys only.  Duplicates in the batch
    collapse to the first record in file order (``order_col``), else to the
    smallest row, so the result is deterministic."""
    others = [c for c in target.columns if c not in keys]
    if others and order_col:
        first = reduce_batch(batch.select(*target.columns, order_col), keys, order_col, "first").drop("__n")
        first = first.select(*target.columns)
    elif others:
        first = (batch.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__r"))
                 .select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others]).select(*target.columns))
    else:
        first = batch.select(*target.columns).distinct()
    new = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new)


def delete_by_keys(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Drop the rows whose key is in ``doomed``."""
    return target.join(doomed.select(*keys).distinct(), keys, "left_anti")


def replace_sets(bridge: DataFrame, new_sets: DataFrame, owner: str = "user_id") -> DataFrame:
    """U16: for every owner present in ``new_sets``, replace all its rows by
    the distinct new ones; other owners keep theirs."""
    kept = bridge.join(new_sets.select(owner).distinct(), owner, "left_anti")
    return kept.unionByName(new_sets.select(*bridge.columns).distinct())


def grant_all(bridge: DataFrame, catalog: DataFrame, user_id: int, id_col: str = "permission_id",
              owner: str = "user_id") -> DataFrame:
    """Give one principal every catalog entry (insert-select), ignoring
    existing grants.  One principal, so this is a projection of the catalog,
    not a product."""
    rows = catalog.select(F.lit(user_id).cast(bridge.schema[owner].dataType).alias(owner), id_col)
    return insert_or_ignore(bridge, rows, [owner, id_col])


def _same(left: str, right: str, fields: list[str]) -> list[Column]:
    return [F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")) for f in fields]


def _patterns(match_fields: list[str], forced: list[str]):
    """(fields to match on, fields that are null) of every null pattern of a record."""
    opt = [f for f in match_fields if f not in forced]
    for r in range(len(opt), -1, -1):
        for present in combinations(opt, r):
            on = [*forced, *present]
            if on:
                yield on, [f for f in opt if f not in present]


def _of_pattern(df: DataFrame, on: list[str], absent: list[str]) -> DataFrame:
    for f in on:
        df = df.filter(F.col(f).isNotNull())
    for f in absent:
        df = df.filter(F.col(f).isNull())
    return df


def _union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def claims(candidates: DataFrame, match_fields: list[str], forced: list[str], keys: list[str]) -> DataFrame:
    """Which candidates insert a row when they come one after another.

    ``candidates`` has one row per distinct match values and key, with its
    place ``__o`` in file order and its record ``__first``.  A candidate
    inserts unless an earlier inserted row agrees with it on all its
    non-null match fields (it updates that row) or holds its key (it is
    refused).  That is a fixpoint: in every round those without an open or
    inserted earlier rival insert, and those that meet an inserted earlier
    row drop out.  A round costs an aggregate and a join per null pattern;
    chains of rivals are short, and the first open candidate is settled in
    every round, so the rounds end.
    """
    open_, inserted = candidates.checkpoint(eager=True), None
    while True:
        rivals = open_.select(*match_fields, *[k for k in keys if k not in match_fields], "__o", F.lit(False).alias("__in"))
        if inserted is not None:
            rivals = rivals.unionByName(inserted.select(*rivals.columns[:-1], F.lit(True).alias("__in")))

        def least(fields: list[str], name: str, rivals: DataFrame = rivals) -> DataFrame:
            known = _of_pattern(rivals, fields, [])
            return known.groupBy(*fields).agg(F.min(F.when(F.col("__in"), F.col("__o"))).alias(f"__{name}_in"),
                                              F.min(F.when(~F.col("__in"), F.col("__o"))).alias(f"__{name}_open"))

        by_values = _union_all([_of_pattern(open_, on, absent).join(least(on, "v"), on, "left").select(
            *open_.columns, "__v_in", "__v_open") for on, absent in _patterns(match_fields, forced)])
        judged = by_values.join(least(keys, "k"), keys, "left")
        gone = F.coalesce(F.col("__v_in") < F.col("__o"), F.lit(False)) | F.coalesce(F.col("__k_in") < F.col("__o"), F.lit(False))
        rival = F.coalesce(F.col("__v_open") < F.col("__o"), F.lit(False)) | F.coalesce(F.col("__k_open") < F.col("__o"), F.lit(False))
        settled = judged.select(*open_.columns, F.when(gone, F.lit("out")).when(~rival, F.lit("in")).otherwise(F.lit("open")).alias("__s")
                                ).checkpoint(eager=True)
        new = settled.filter("__s = 'in'").drop("__s")
        inserted = new if inserted is None else inserted.unionByName(new)
        open_ = settled.filter("__s = 'open'").drop("__s")
        if open_.isEmpty():
            return inserted


def merge_on_match_fields(target: DataFrame, batch: DataFrame, match_fields: list[str], mode: str = "upsert", *,
                          run_ts: str, order_col: str = "row_number", forced: list[str] = (),
                          target_key: list[str]) -> MergeResult:
    """Match a record on the AND of its match fields that are non-null
    (``forced`` fields always included); records with none are skipped.

    A record's null pattern says which fields it is matched on.  The batch is
    reduced once, to one row per distinct match values (nulls included): its
    last record in file order and the number of records.  That small frame
    is stored and joined to the target once per pattern that can occur (at
    most 2^k for k match fields); the join output is the set of target rows
    to update - never records x rows of a group.  A record may hit several
    rows (U10, counted per row hit); when records of different patterns hit
    one row the last in file order wins.

    Records whose values hit no stored row apply one after another: the first
    one inserts, and later ones that agree with an inserted row update it
    (``claims``).  A record that matches nothing but whose key a stored or
    inserted row holds cannot be inserted: it comes back in ``rejected``.
    Records are in file order by ``order_col``, those equal in it by their
    match values and key.  Bound: rows are matched by the values they had when
    they were stored or inserted, not by what a later record of the batch
    makes of them."""
    from rollcall.operators.ordering import count_up_to
    from rollcall.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(batch.sparkSession)
    tk, forced = list(target_key), list(forced)
    opt = [f for f in match_fields if f not in forced]
    values = [c for c in batch.columns if c != order_col]
    usable = batch
    for f in forced:
        usable = usable.filter(F.col(f).isNotNull())
    if not forced:
        usable = usable.filter(F.greatest(*[F.col(f).isNotNull() for f in opt]) if len(opt) > 1
                               else F.col(opt[0]).isNotNull())
    keys_besides = [k for k in tk if k in values and k not in match_fields]
    usable = usable.withColumn("__o", F.struct(order_col, *match_fields, *keys_besides))
    record = F.struct(*values)
    reduced = (usable.groupBy(*match_fields)
               .agg(F.max_by(record, "__o").alias("__r"), F.count(F.lit(1)).alias("__n"), F.min("__o").alias("__from"),
                    F.max("__o").alias("__to"))).checkpoint(eager=True)
    hits, unmatched = [], []
    for on, absent in _patterns(match_fields, forced):
        group = _of_pattern(reduced, on, absent)
        probe = target.select(*[F.col(k).alias(f"__tk_{k}") for k in tk], *on)
        hits.append(group.drop(*absent).join(probe, on, "inner").select(*[f"__tk_{k}" for k in tk], "__r", "__n", "__to"))
        unmatched.append(group.join(target.select(*on).distinct(), on, "left_anti").select(*match_fields))
    matched, missed = _union_all(hits), _union_all(unmatched)
    tkc = [f"__tk_{k}" for k in tk]
    # per target row: the last record among the groups that hit it; records counted per row hit
    upd = (matched.groupBy(*tkc).agg(F.max_by("__r", "__to").alias("r"), F.sum("__n").alias("__n"))
           .select(*tkc, F.lit(True).alias("__tid"), "__n", *[F.col(f"r.{c}").alias(c) for c in values]))
    ts = _ts(run_ts)
    updating = mode in ("upsert", "update")
    hit = F.col("u.__tid").isNotNull() if updating else F.lit(False)
    cols = []
    for c in target.columns:
        if c in values and c not in target_key:
            cols.append(F.when(hit, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, ts).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}").alias(c))
    old = F.struct(*[F.col(f"t.{c}").alias(c) for c in target.columns]).alias("__old")
    on_key = [F.col(f"t.{k}") == F.col(f"u.__tk_{k}") for k in tk]
    applied = target.alias("t").join(upd.alias("u"), on_key, "left").select(*cols, old, F.when(hit, F.lit("UPDATE")).alias("__op"))
    outcome = upd.select(*[F.col(f"__tk_{k}").alias(k) for k in tk], F.lit(0).cast("long").alias("inserted"),
                         F.col("__n").cast("long").alias("updated"))
    rejected = None
    if mode in ("upsert", "create"):
        new = usable.alias("n").join(missed.alias("m"), _same("n", "m", match_fields), "left_semi")
        candidates = new.join(target.select(*tk), tk, "left_anti").groupBy(*match_fields, *keys_besides).agg(
            F.min("__o").alias("__o"), F.min_by(record, "__o").alias("__first"))
        arrived = claims(candidates, match_fields, forced, tk).checkpoint(eager=True)
        # which later records hit the inserted rows: one pair per row and null pattern at most
        pairs = []
        for on, absent in _patterns(match_fields, forced):
            rows = _of_pattern(arrived, on, []).select(*on, *[F.col(f"__first.{k}").alias(f"__tk_{k}") for k in tk], F.col("__o").alias("__at"))
            pairs.append(_of_pattern(reduced, on, absent).join(rows, on).select(*reduced.columns, *tkc, "__at"))
        pairs = _union_all(pairs).checkpoint(eager=True)
        # records at or before the insertion of the row don't count for it
        early = pairs.filter(F.col("__from") <= F.col("__at"))
        marks = early.filter(F.col("__to") > F.col("__at")).select(*match_fields, F.col("__at").alias("__o"), *tkc, "__r", "__n", "__to")
        of_marks = usable.alias("n").join(marks.select(*match_fields).distinct().alias("m"), _same("n", "m", match_fields), "left_semi")
        later = count_up_to(of_marks.select(*match_fields, "__o"), marks, match_fields, "__o", "__gone").select(
            *tkc, "__r", (F.col("__n") - F.col("__gone")).alias("__n"), "__to")
        later = later.unionByName(pairs.filter(F.col("__from") > F.col("__at")).select(*tkc, "__r", "__n", "__to"))
        after = (later.groupBy(*tkc).agg(F.max_by("__r", "__to").alias("r"), F.sum("__n").cast("long").alias("__n"))
                 .select(*tkc, F.lit(True).alias("__tid"), "__n", *[F.col(f"r.{c}").alias(c) for c in values]))
        reach = pairs.groupBy(*match_fields).agg(F.min("__at").alias("__at"))
        rejected = new.alias("n").join(reach.alias("p"), _same("n", "p", match_fields), "left").filter(
            F.col("__at").isNull() | (F.col("n.__o") < F.col("__at"))).select(*[F.col(f"n.{c}").alias(c) for c in (*tk, order_col)])
        inserts = arrived.select("__first.*", F.lit(1).alias(order_col))
        fresh = merge_keyed(target.limit(0), inserts, target_key, "create", run_ts=run_ts, order_col=order_col)
        born = fresh.applied.filter(F.col("__op") == "INSERT")
        final = [F.when(F.col("u.__tid"), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
                 if updating and c in values and c not in tk else F.col(f"t.{c}").alias(c) for c in target.columns]
        born = born.alias("t").join(after.alias("u"), on_key, "left").select(*final, "t.__old", "t.__op")
        applied = applied.unionByName(born)
        counted = fresh.outcome.alias("t").join(after.alias("u"), on_key, "left").select(
            *[F.col(f"t.{k}").alias(k) for k in tk], "inserted",
            (F.coalesce("u.__n", F.lit(0)) if updating else F.lit(0)).cast("long").alias("updated"))
        outcome = (outcome if mode == "upsert" else outcome.limit(0)).unionByName(counted)
    return MergeResult(state=applied.select(*target.columns), outcome=outcome, before=target, applied=applied,
                       keys=tuple(tk), run_ts=run_ts, rejected=rejected)


# What an unmapped counter column holds when a re-import resets it.
RESET_VALUES = {"valid": False, "likes": 0, "comments": 0}


def with_unmapped_counters(records: DataFrame, reset: bool = False,
                           columns: dict[str, object] = RESET_VALUES) -> DataFrame:
    """Counter columns a re-import did not map.  By default they are true
    nulls, so a COALESCE merge (U6) keeps the stored values.  ``reset=True``
    reproduces the source importers, which send false / 0 for unmapped
    columns and so overwrite validity, likes and comments."""
    for c, v in columns.items():
        if c not in records.columns:
            value = F.lit(v) if reset else F.lit(None)
            records = records.withColumn(c, value.cast(_type_of(v)))
    return records


def _type_of(v) -> str:
    return "boolean" if isinstance(v, bool) else "int"
