"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.
The model predicts symbols: the most frequent tokens are symbols of their own,
all others share ``TAILS`` symbols by their last bytes.  Symbols fall into
classes by rank; P(symbol) = P(class) * P(symbol in class), and each factor is
a softmax whose weights are rows of one table, picked by the features of the
context: none (bias), the symbol before, the one before that (a skip feature),
and the hashed pair of both.  A token that shares its symbol gets the smoothed share of
its count within the symbol, where one place is kept for words never seen, so
the probabilities of a text's continuations add up to one.

Everything is learned from all training rows: token counts by a distributed
aggregation, and training events (two symbols of context and the symbol that
follows) likewise.  Training runs in rounds of distributed gradient updates:
each partition of the event table makes local passes from the round's weights
and returns the change of the rows it touched with the number of events
behind it; the changes are averaged by that number, row by row, on the
executors.  Only the weight table (``ROWS`` x ``WIDTH``, fixed) goes through the
driver.  Pairs are dealt into ``GROUPS`` groups, each with its own rows, and a
partition holds whole groups: the change of a pair's row comes from one place.

Scoring looks up the ``KEPT`` most frequent tokens in a sent table; counts of
all rarer ones are joined by a shuffle, so base scores are exact.

Defined cases: a null or empty text has one token, its end; rows with a null
id count as id '' in the folds; without training rows every count is 0 and
the model keeps equal weights; equal rows are scored each for itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import Stored, fold, get_ready, map_text

FOLDS, HELD_OUT = 7, 2
END = b"\n"                     # no word holds white space
KEPT = 1 << 17                  # tokens whose counts are sent to the executors
TAILS = 64                      # symbols of all tokens beyond the model's own
CLASSES, WIDTH = 32, 32         # classes, and symbols of a class
SYMBOLS = CLASSES * WIDTH
OWN = SYMBOLS - TAILS           # tokens with a symbol of their own
START = SYMBOLS                 # context before the first token
FACTORS = CLASSES + 1           # the class factor, and one per class
GROUPS, GROUP_ROWS = 256, 512   # hashed rows of the pair feature
SINGLE = FACTORS * (2 * (SYMBOLS + 1) + 1)      # rows of the bias, the symbol before, the skip feature
ROWS = SINGLE + GROUPS * GROUP_ROWS
SHRINK = 4.0                    # events by which a row's change is damped
ROUNDS, PASSES, BATCH = 3, 2, 1 << 14
FLUSH = 1 << 19                 # distinct entries a task holds before it passes them on


def tokens(text: str | None) -> list[bytes]:
    """Words and the end."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    found.append(END)
    return found


def tail_symbol(token: bytes) -> int:
    return OWN + zlib.crc32(token[-3:]) % TAILS


def tail_symbol_column(token: Column) -> Column:
    return (F.lit(OWN) + F.crc32(F.substring(token.cast("binary"), -3, 3)) % TAILS).cast("int")


def count_tokens(docs: DataFrame) -> DataFrame:
    """``token``, ``n`` over all rows of ``docs`` (column text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()),
                                            pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
            counts.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(tokens(t))
            if len(counts) >= FLUSH // 2:
                yield out()
        yield out()

    partial = docs.select("text").mapInArrow(run, "token string, n bigint")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The ``KEPT`` most frequent tokens in order of frequency, and the totals."""
    place: dict[bytes, int]
    count: np.ndarray
    total: int                  # N
    distinct: int               # V
    tail_total: np.ndarray      # per tail symbol
    tail_distinct: np.ndarray

    def __post_init__(self) -> None:
        own = np.arange(len(self.count))
        tails = np.fromiter((tail_symbol(t) for t in self.place), np.int64, len(self.place))
        self.symbol = np.where(own < OWN, own, tails)
        self.log_base_room = np.log10(self.total + self.distinct + 1)
        self.log_tail_room = np.log10(self.tail_total + self.tail_distinct + 1)
        self.log_count = np.log10(self.count + 1.0)
        inside = self.log_count - self.log_tail_room[np.maximum(self.symbol - OWN, 0)]
        self.log_inside = np.where(own < OWN, 0.0, inside)

    def encode(self, texts: list[str | None]):
        """(places, symbols, ends of the texts, rare tokens): places are -1 for tokens beyond the table."""
        flat: list[bytes] = []
        ends = []
        for t in texts:
            flat += tokens(t)
            ends.append(len(flat))
        get = self.place.get
        place = np.fromiter([get(t, -1) for t in flat], np.int64, len(flat))
        rare = np.flatnonzero(place < 0)
        symbol = self.symbol[place] if len(self.symbol) else np.zeros(len(flat), np.int64)
        if len(rare):
            symbol[rare] = [tail_symbol(flat[i]) for i in rare.tolist()]
        return place, symbol, np.array(ends, np.int64), rare, flat


def events(symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(symbol two before, symbol before, symbol) as one number per token."""
    one = np.concatenate(([START], symbol[:-1]))
    two = np.concatenate(([START, START], symbol[:-2]))[:len(symbol)]
    starts = np.concatenate(([0], ends[:-1]))
    starts = starts[starts < len(symbol)]
    one[starts] = START
    two[starts] = START
    second = starts + 1
    second = second[second < len(symbol)]
    two[np.setdiff1d(second, starts)] = START
    return (two << 24) | (one << 12) | symbol


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their counts added up."""
    c, place = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(place, np.concatenate(counts), len(c)).astype(np.int64)


def count_events(docs: DataFrame, vocabulary, parts: int) -> DataFrame:
    """``event``, ``n`` over all rows; ``vocabulary`` is a broadcast variable.

    A task counts its events and passes them on as sorted runs, one packed row
    per group of pairs; a group's runs meet in one of ``parts`` partitions, which
    adds them up and returns its events in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, codes, counts, size = vocabulary.value, [], [], 0

        def out(c, n) -> pa.RecordBatch:
            group = group_of(c >> 12)
            order = np.argsort(group, kind="stable")
            group, c, n = group[order], c[order], n[order]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(starts[1:], len(c))
            return pa.RecordBatch.from_arrays(
                [pa.array(group[starts], pa.int64()),
                 pa.array([np.diff(c[a:b], prepend=0).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                 pa.array([n[a:b].astype("<i8").tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                names=["group", "steps", "counts"])

        for b in batches:
            if not b.num_rows:
                continue
            _, symbol, ends, _, _ = v.encode(b.column(0).to_pylist())
            c, n = np.unique(events(symbol, ends), return_counts=True)
            codes.append(c)
            counts.append(n)
            size += len(c)
            if size > 2 * FLUSH:
                c, n = _added(codes, counts)
                if len(c) > FLUSH:
                    yield out(c, n)
                    codes, counts, size = [], [], 0
                else:
                    codes, counts, size = [c], [n], len(c)
        if codes:
            yield out(*_added(codes, counts))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, size = [], [], 0
        for b in batches:
            for steps, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                codes.append(np.cumsum(np.frombuffer(steps, "<i8")))
                counts.append(np.frombuffer(n, "<i8"))
                size += len(codes[-1])
                if size > 4 * FLUSH:
                    c, n = _added(codes, counts)
                    codes, counts, size = [c], [n], len(c)
        if codes:
            c, n = _added(codes, counts)
            for at in range(0, len(c), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 16)]), pa.array(n[at:at + (1 << 16)])], names=["event", "n"])

    packed = docs.select("text").mapInArrow(run, "group bigint, steps binary, counts binary")
    return packed.repartition(parts, "group").mapInArrow(merge, "event bigint, n bigint")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def group_of(pair):
    """Group of a pair of symbols (numpy or Spark numbers alike: no product leaves 63 bits)."""
    if isinstance(pair, Column):
        return F.shiftright(pair * F.lit(2654435761).cast("bigint"), 16).bitwiseAND(F.lit(GROUPS - 1).cast("bigint"))
    return ((pair * 2654435761) >> 16) & (GROUPS - 1)


def feature_rows(event: np.ndarray, factor: np.ndarray) -> list[np.ndarray]:
    """Rows of the weight table: one per feature and event.  ``factor`` is 0 for the class factor, else the class + 1."""
    two, one, pair = event >> 24, (event >> 12) & 0xFFF, event >> 12
    hashed = (_mix((pair << 6) | factor) % np.uint64(GROUP_ROWS)).astype(np.int64)
    return [factor, FACTORS * (1 + one) + factor, FACTORS * (2 + SYMBOLS + two) + factor,
            SINGLE + group_of(pair) * GROUP_ROWS + hashed]


def _log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[0]]
    for r in rows[1:]:
        z = z + weights[r]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _groups(event: np.ndarray, by_class: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first event, group of each event, factor of each group) of neighbours that share one softmax: those of
    a context for the class factor, those of a context and class for the other.  Events come sorted, so what
    shares a softmax lies together; where it does not, it is only computed more than once."""
    symbol_class = (event & 0xFFF) // WIDTH
    key = ((event >> 12) << 6) | (symbol_class + 1 if by_class else 0)
    new = np.ones(len(event), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.cumsum(new) - 1, symbol_class[first] + 1 if by_class else np.zeros(len(first), np.int64)


def log_probabilities(weights: np.ndarray, event: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(symbol | context) per event."""
    out = np.zeros(len(event))
    for at in range(0, len(event), BATCH):
        e = event[at:at + BATCH]
        symbol = e & 0xFFF
        for by_class, target in ((False, symbol // WIDTH), (True, symbol % WIDTH)):
            first, group, factor = _groups(e, by_class)
            out[at:at + BATCH] += _log_softmax(weights, feature_rows(e[first], factor))[group, target]
    return out


def _update(weights: np.ndarray, seen: np.ndarray, event: np.ndarray, n: np.ndarray, count_seen: bool) -> None:
    """One gradient step on a batch: each row moves by its mean gradient, damped where few events stand behind it."""
    symbol = event & 0xFFF
    for by_class, target in ((False, symbol // WIDTH), (True, symbol % WIDTH)):
        first, group, factor = _groups(event, by_class)
        rows = feature_rows(event[first], factor)
        total = np.add.reduceat(n, first)
        g = np.exp(_log_softmax(weights, rows)) * total[:, None]
        g -= np.bincount(group * WIDTH + target, n, len(first) * WIDTH).reshape(-1, WIDTH).astype(np.float32)
        for r in rows:
            order = np.argsort(r, kind="stable")
            start = np.flatnonzero(np.diff(r[order], prepend=-1))
            ids = r[order][start]
            many = np.add.reduceat(total[order], start)
            weights[ids] -= np.add.reduceat(g[order], start, axis=0) / (many + SHRINK)[:, None]
            if count_seen:
                seen[ids] += many


def train(event_table: DataFrame, stored: Stored, rounds: int = ROUNDS) -> np.ndarray:
    """The weight table after ``rounds`` rounds over all events."""
    spark = event_table.sparkSession
    weights = np.zeros((ROWS, WIDTH), np.float32)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            local, seen = sent.value.copy(), np.zeros(ROWS, np.float32)
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if not parts:
                return
            event = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts]).astype(np.float32)
            for k in range(PASSES):
                for at in range(0, len(event), BATCH):
                    _update(local, seen, event[at:at + BATCH], n[at:at + BATCH], k == 0)
            touched = np.flatnonzero(seen)
            change = ((local - sent.value)[touched] * seen[touched, None]).astype("<f4")
            for at in range(0, len(touched), 4096):
                s = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(touched[s], pa.int64()), pa.array(seen[touched[s]].astype(float), pa.float64()),
                     pa.array([x.tobytes() for x in change[s]], pa.binary())], names=["row", "seen", "change"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b in batches:
                for row, seen, change in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    x = np.frombuffer(change, "<f4").astype(np.float64)
                    if row in total:
                        total[row][0] += seen
                        total[row][1] += x
                    else:
                        total[row] = [seen, x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()),
                 pa.array([(x / s).astype("<f4").tobytes() for s, x in total.values()], pa.binary())], names=["row", "change"])

        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        moved = stored.put(event_table.mapInArrow(run, "row bigint, seen double, change binary")
                           .repartition(parts, "row").sortWithinPartitions("row", "seen", "change").mapInArrow(mean, "row bigint, change binary"), f"round-{turn}")
        got = moved.toArrow()
        if got.num_rows:
            ids = got.column("row").to_numpy()
            weights = weights.copy()
            weights[ids] += np.frombuffer(b"".join(got.column("change").to_pylist()), "<f4").reshape(-1, WIDTH)
        sent.unpersist()
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row."""
    spark = get_ready(docs.sparkSession)
    stored = Stored(spark, "lm-score")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learn = docs.filter(fold("doc_id", FOLDS) != HELD_OUT)
    counts = stored.put(count_tokens(learn), "counts")
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    # the most frequent tokens: a fixed number of rows
    kept = counts.orderBy(F.desc("n"), "token").limit(KEPT).toArrow()
    names = kept.column("token").cast(pa.binary()).to_pylist()
    number = kept.column("n").to_numpy()
    tails = counts.groupBy(tail_symbol_column(F.col("token")).alias("symbol")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tail_total, tail_distinct = np.zeros(TAILS), np.zeros(TAILS)
    for r in tails:
        tail_total[r["symbol"] - OWN], tail_distinct[r["symbol"] - OWN] = r["n"], r["v"]
    for t, n in zip(names[:OWN], number[:OWN].tolist(), strict=True):       # these have symbols of their own
        tail_total[tail_symbol(t) - OWN] -= n
        tail_distinct[tail_symbol(t) - OWN] -= 1
    v = Vocabulary({t: i for i, t in enumerate(names)}, number, int(whole["total"] or 0), int(whole["distinct"]),
                   tail_total, tail_distinct)
    vocabulary = spark.sparkContext.broadcast(v)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    learned = stored.put(count_events(learn, vocabulary, parts), "events")
    weights = spark.sparkContext.broadcast(train(learned, stored))

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
              T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()),
              T.StructField("rare", T.ArrayType(T.StructType([T.StructField("token", T.StringType()),
                                                              T.StructField("n", T.LongType())])))]

    def run(batches):
        v, w = vocabulary.value, weights.value
        for texts in batches:
            place, symbol, ends, rare, flat = v.encode(texts)
            starts = np.concatenate(([0], ends[:-1]))
            code, back = np.unique(events(symbol, ends), return_inverse=True)
            log_p = (log_probabilities(w, code) / np.log(10))[back]
            is_rare = place < 0
            if len(v.count):
                base = np.where(is_rare, 0.0, v.log_count[place]) - v.log_base_room
                inside = np.where(is_rare, -v.log_tail_room[np.maximum(symbol - OWN, 0)], v.log_inside[place])
            else:
                base, inside = np.full(len(place), -v.log_base_room), -v.log_tail_room[symbol - OWN]
            found: list[Counter] = [Counter() for _ in texts]
            for i, d in zip(rare.tolist(), np.searchsorted(ends, rare, "right").tolist(), strict=True):
                found[d][flat[i]] += 1
            yield [np.diff(ends, prepend=0), np.add.reduceat(~is_rare, starts, dtype=np.int64),
                   np.add.reduceat(base, starts), np.add.reduceat(log_p + inside, starts),
                   [[{"token": t.decode("utf-8", "replace"), "n": n} for t, n in c.items()] for c in found]]

    scored = map_text(docs, "text", fields, run).select(
        F.monotonically_increasing_id().alias("at"), F.col("row.doc_id").alias("doc_id"), *[f.name for f in fields])
    scored = stored.put(scored, "scored")
    rare = (scored.select("at", F.explode("rare").alias("r")).select("at", F.col("r.token").alias("token"),
                                                                    F.col("r.n").alias("times"))
            .join(counts, "token").groupBy("at")
            .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs")))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(rare, "at", "left").select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"), (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"))
