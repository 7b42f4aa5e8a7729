"""Benchmark decontamination by Wu-Manber search over words.

A window is ten consecutive words of a benchmark item; an item of fewer
words, but not none, is one window.  A document word inside any occurrence of
a window is hit.

The windows of one length form one Wu-Manber table.  Its symbols are words
(only words that occur in the benchmark have numbers; all others are number
0), its blocks are pairs of words.  The shift table says how far the search
may move on when a block ends at a position; a block that ends some window
has shift 0 and leads, through its bucket and the window's first block, to
the windows that are then compared word by word.

The benchmark is cut into slices by tasks, stored, and dealt into numbered
blocks of bounded size.  One block at a time is sent to the executors and
searched in a pass over all documents.  A benchmark of one block needs one
pass and no shuffle.  With more blocks each pass stores only the hits, keyed by
a digest of the text, and the hits of all blocks are merged and joined back, so
neither a task nor the driver ever holds more than one block.

Defined cases: a null or empty text has no words and no hits; items without
words have no windows; windows of items with a null id hit, but only ids can be
listed; rows with the same item_id are one item; equal document rows are judged
each for itself; other columns of the input are kept as they are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import Stored, get_ready, map_text, words_of

WINDOW = 10
BLOCK_BYTES = 16 << 20      # of benchmark words per block that is sent to the executors
WORD_COST = 40              # bytes that a word costs beside its own


class Table:
    """Wu-Manber tables for windows of one length (lists of word numbers over 1)."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], list[int]], base: int):
        self.length, self.base = length, base
        self.block = block = min(2, length)
        self.far = length - block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[list[int], list[int]]]]] = defaultdict(lambda: defaultdict(list))
        for w, items in windows.items():
            for end in range(block - 1, length):
                key = self._key(w, end)
                move = length - 1 - end
                if move < self.shift.get(key, self.far):
                    self.shift[key] = move
            self.buckets[self._key(w, length - 1)][self._key(w, block - 1)].append((list(w), items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def _key(self, w, end: int) -> int:
        return w[end - 1] * self.base + w[end] if self.block == 2 else w[end]

    def search(self, ids: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence."""
        n, length, base, far = len(ids), self.length, self.base, self.far
        shift, buckets = self.shift.get, self.buckets
        at = length - 1
        if self.block == 2:
            while at < n:
                key = ids[at - 1] * base + ids[at]
                move = shift(key, far)
                if move:
                    at += move
                    continue
                start = at - length + 1
                for window, items in buckets[key].get(ids[start] * base + ids[start + 1], ()):
                    if ids[start:at + 1] == window:
                        yield start, items
                at += 1
        else:
            for at, word in enumerate(ids):
                for _, items in buckets.get(word, {}).get(word, ()):
                    yield at, items


class Matcher:
    """The tables of one block of benchmark slices (item number, words)."""

    def __init__(self, slices: list[tuple[int, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(dict)
        for item, words in slices:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners = by_length[size].setdefault(tuple(ids[i:i + size]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        base = len(self.numbers) + 1
        self.tables = [Table(size, windows, base) for size, windows in by_length.items()]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches (start, end), not yet merged, and the items found."""
        number = self.numbers.get
        ids = [number(w, 0) for w in words]
        spans, items = [], set()
        for t in self.tables:
            for start, owners in t.search(ids):
                if spans and spans[-1][1] >= start >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], start + t.length))
                else:
                    spans.append((start, start + t.length))
                items.update(owners)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def slices_of(benchmark: DataFrame, window: int, block_bytes: int, item_col: str, text_col: str) -> DataFrame:
    """``item`` (id as string), ``words`` (space-joined) and ``cost`` of every slice of the benchmark.

    A long item is cut into slices that overlap by ``window`` - 1 words, so
    each window lies in exactly one slice and no slice outgrows a block.
    """
    most = max(window, block_bytes // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, most):
                    part = words[at:at + most + window - 1]
                    cost = sum(map(len, part)) + WORD_COST * len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item], pa.string()), pa.array([b" ".join(part)], pa.binary()), pa.array([cost], pa.int64())],
                        names=["item", "words", "cost"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct()
    return rows.mapInArrow(run, "item string, words binary, cost bigint")


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_MATCHERS: dict = {}


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the input row), ``n_words``, ``spans`` (hit stretches of words,
    apart and in order) and ``items`` (ids of the items with occurring windows,
    each once, sorted as strings; ids are returned as strings)."""
    spark = get_ready(docs.sparkSession)
    stored = Stored(spark, "decontamination")
    slices = stored.put(slices_of(benchmark, window, block_bytes, item_col, item_text_col), "slices")
    blocks = max(1, -(-(slices.agg(F.sum("cost")).first()[0] or 0) // block_bytes))
    dealt = slices.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    if blocks > 1:
        dealt = stored.put(dealt.repartition(blocks, "block").sortWithinPartitions("block"), "blocks")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS),
              T.StructField("items", T.ArrayType(T.StringType()))]
    call = uuid.uuid4().hex     # names the tables that a Python worker keeps

    def one_pass(n: int):
        key = f"{call}-{n}"
        block = spark.sparkContext.broadcast(           # about ``block_bytes``
            [(r.item, bytes(r.words).split()) for r in dealt.filter(F.col("block") == n).collect()])

        def run(batches):
            if key not in _MATCHERS:
                _MATCHERS.clear()
                _MATCHERS[key] = (Matcher([(i, w) for i, (_, w) in enumerate(block.value)], window), [i for i, _ in block.value])
            matcher, names = _MATCHERS[key]
            for texts in batches:
                out = ([], [], [])
                for t in texts:
                    words = words_of(t)
                    spans, items = matcher.hits(words)
                    out[0].append(len(words))
                    out[1].append([{"start": a, "end": b} for a, b in merged(spans)])
                    out[2].append(sorted({names[i] for i in items} - {None}))
                yield list(out)
        return run, block

    if blocks == 1:
        return map_text(docs, text_col, fields, one_pass(0)[0])

    texts = docs.select(_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")).filter("text is not null")
    passes = []
    for n in range(blocks):
        run, block = one_pass(n)
        hits = (map_text(texts, "text", fields, run).filter(F.size("spans") > 0)
                .groupBy(F.col("row.digest").alias("digest"))       # equal texts have equal hits
                .agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        passes.append(stored.put(hits, f"hits-{n}"))
        block.unpersist()
    hits = (reduce(DataFrame.unionByName, passes).groupBy("digest")
            .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
            .select("digest", _merge_spans(F.col("spans")).alias("spans"),
                    F.array_sort(F.array_distinct("items")).alias("items")))
    counted = map_text(docs, text_col, fields[:1], lambda batches: ([[len(words_of(t)) for t in texts]] for texts in batches))
    # rows without a text have no hits; their keys differ by row, so that they don't meet in one task
    key = F.coalesce(_digest(F.col(f"row.`{text_col}`")), F.xxhash64("row").cast("string"))
    return counted.withColumn("digest", key).join(hits, "digest", "left").select(
        "row", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _merge_spans(spans: Column) -> Column:
    """Union of (start, end) stretches, in order."""
    empty = F.lit([]).cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), empty, step)


def hit_words(spans: Column | str) -> Column:
    """Number of words in the stretches."""
    c = F.col(spans) if isinstance(spans, str) else spans
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def clean_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    return find(docs, benchmark, **options).filter(F.size("spans") == 0).select("row.*")
