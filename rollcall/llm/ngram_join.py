"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

Two texts are linked when the sets of their word n-grams (five words; words
as in ``common.words_of``) have a Jaccard similarity of 0.8 or more.  Texts
of one to four words have one n-gram, all their words.

1. One pass sketches every row: ``node``, a 64-bit hash of the word sequence,
   and one hash per band of MinHash values.  Rows of one node are copies and
   go on as a single row with their number.
2. Nodes are shuffled on band hashes; each shared bucket ties its nodes to its
   smallest one.  The components of these ties hold every candidate pair.
3. The members of a component are dealt into blocks of bounded size and every
   two blocks meet in one group, where all pairs are verified on whole n-gram
   sets.  A group gives back the number of links per node and a spanning
   forest of its links, never the pairs.
4. Components of the spanning links are the classes.

Band and row counts follow from the target recall at the threshold
(``bands_for``).  A component of any size is verified in full; its blocks
keep memory per task constant.

Defined cases: null texts and texts without words have no n-grams, link to
nothing and are classes of their own; the class id is the smallest id of the
class (null only if all ids are null); rows with equal texts are links of
each other, whatever their ids; the n-grams are held as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import Stored, get_ready, map_text, words_of

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
BAND_ROWS = 8
BLOCK_NODES = 64                # nodes of a component per block
BLOCK_CHARS = 1 << 21           # and characters
SALTS = 8                       # of a star's edges
_CHUNK = 1 << 15                # n-grams that are hashed at once


def bands_for(threshold: float, recall: float, rows: int = BAND_ROWS) -> int:
    """Bands of ``rows`` values each so that a pair at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


class WordHashes(dict):
    """Word -> 64-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(words: list[bytes], hashes: WordHashes, n: int = NGRAM) -> np.ndarray:
    """One 64-bit hash per n-gram, in order, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - size + 1 + i]
    return _mixed(h)


class Sketcher:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 1 << 64, bands * rows, np.uint64, endpoint=False) | np.uint64(1)
        self.salts = rng.integers(0, 1 << 64, bands, np.uint64, endpoint=False)

    def band_hashes(self, grams: list[np.ndarray]) -> np.ndarray:
        """(documents, bands) for documents with at least one n-gram each."""
        mins = np.full((len(self.factors), len(grams)), np.iinfo(np.uint64).max, np.uint64)
        ends = np.cumsum([len(g) for g in grams])
        flat = np.concatenate(grams)
        first = 0
        for at in range(0, len(flat), _CHUNK):
            part = flat[at:at + _CHUNK]
            first = int(np.searchsorted(ends, at, "right"))
            last = int(np.searchsorted(ends, at + len(part) - 1, "right"))
            starts = np.maximum(np.concatenate(([0], ends))[first:last + 1] - at, 0)
            tmp = np.empty_like(part)
            for k, a in enumerate(self.factors):
                np.multiply(part, a, out=tmp)
                got = np.minimum.reduceat(tmp, starts)
                np.minimum(mins[k, first:last + 1], got, out=mins[k, first:last + 1])
        out = np.empty((len(grams), self.bands), np.uint64)
        for b in range(self.bands):
            h = np.full(len(grams), self.salts[b], np.uint64)
            for k in range(b * self.rows, (b + 1) * self.rows):
                h = _mixed(h ^ mins[k]) * np.uint64(0x9E3779B97F4A7C15)
            out[:, b] = _mixed(h)
        return out


def _node(words: list[bytes]) -> int | None:
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
           recall: float = RECALL, n: int = NGRAM) -> DataFrame:
    """``doc_id``, ``node``, ``n_chars`` and ``bands`` (array of long) of every row."""
    bands = bands_for(threshold, recall)

    def run(batches):
        sketcher, hashes = Sketcher(bands, BAND_ROWS), WordHashes()
        for texts in batches:
            words = [words_of(t) for t in texts]
            grams = [ngram_hashes(w, hashes, n) for w in words]
            full = [i for i, g in enumerate(grams) if len(g)]
            out = [None] * len(texts)
            if full:
                found = sketcher.band_hashes([grams[i] for i in full]).view(np.int64)
                for i, h in zip(full, found, strict=True):
                    out[i] = h
            yield [[_node(w) for w in words], [len(t or "") for t in texts], out]

    fields = [T.StructField("node", T.LongType()), T.StructField("n_chars", T.LongType()),
              T.StructField("bands", T.ArrayType(T.LongType()))]
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(few, "text", fields, run).select(F.col("row.doc_id").alias("doc_id"), "node", "n_chars", "bands")


def with_node(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input row) and its ``node``."""
    def run(batches):
        for texts in batches:
            yield [[_node(words_of(t)) for t in texts]]

    return map_text(docs, text_col, [T.StructField("node", T.LongType())], run)


def components(edges: DataFrame, stored: Stored, name: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``edges`` (u, v).

    Large-star and small-star rounds until nothing changes; every round is a
    stored table, aggregates before it joins, and never gathers a component.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # the centre of a large star is one key: its edges are spread over salts, the one row of its minimum is repeated
        salted = both.filter("v > u").withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
        lows = low.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        large = salted.join(lows, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        return (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                .union(least.select("u", F.col("m").alias("v"))).distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.hash("u", "v").cast("bigint"))).first())

    # every edge points from the larger node to the smaller one
    now = stored.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                     .filter("u <> v").distinct(), f"{name}-0")
    seen, turn = mark(now), 0
    while seen[0]:
        turn += 1
        after = stored.put(stars(now), f"{name}-{turn}")
        stored.drop(f"{name}-{turn - 1}")
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    root = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return root.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix over all members; pairs are verified between ``left`` and ``right`` members only."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        inter = np.zeros((2, 2), np.int64)
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1
        column = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(n), sizes)
        keep = shared[place]
        owner, column = owner[keep], column[place[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        inter = np.zeros((n, n), np.float32)
        total = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, total, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            m = np.zeros((n, min(4096, total - at)), np.float32)
            m[owner[a:b], column[a:b] - at] = 1
            inter += m @ m.T
        inter = inter.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    linked = inter >= threshold * union - 1e-9
    allowed = left[:, None] & right[None, :]
    linked &= allowed | allowed.T
    np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    seen = np.zeros(len(linked), bool)
    for start in range(len(linked)):
        if seen[start]:
            continue
        seen[start] = True
        front = [start]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            for b in new:
                yield at, int(b)
            front.extend(new.tolist())


def _verify(threshold: float, n: int):
    """Streams sorted rows (comp, i, j, node, copies, block, text) group by group."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def group(rows: dict[int, tuple[int, int, str]], i: int, j: int, hashes: WordHashes, out: list) -> None:
        nodes = list(rows)
        if len(nodes) < 2:
            return
        copies = np.array([rows[x][0] for x in nodes], np.int64)
        blocks = np.array([rows[x][1] for x in nodes])
        sets = [np.unique(ngram_hashes(words_of(rows[x][2]), hashes, n)) for x in nodes]
        linked = _similar(sets, blocks == i, blocks == j, threshold)
        for k, count in enumerate((linked * copies[None, :]).sum(axis=1).tolist()):
            if count:
                out.append((nodes[k], count, None))
        out.extend((nodes[a], 0, nodes[b]) for a, b in _forest(linked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, rows, out = WordHashes(), None, {}, []

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for b in batches:
            for comp, i, j, node, copies, block, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (comp, i, j) != key:
                    if key:
                        group(rows, key[1], key[2], hashes, out)
                    key, rows = (comp, i, j), {}
                rows[node] = (copies, block, text)
            if len(out) > 4096:
                yield flushed()
        if key:
            group(rows, key[1], key[2], hashes, out)
        yield flushed()

    return run


def classes(docs: DataFrame, sketched: DataFrame, stored: Stored, text_col: str = "text", id_col: str = "doc_id",
            threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``node``, ``class_node``, ``class_id`` and ``n_links`` of every node that has a link.

    ``sketched`` is the stored output of ``sketch`` over the same rows.
    """
    nodes = stored.put(
        sketched.filter(F.col("node").isNotNull()).groupBy("node")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("n_chars"),
             F.first("bands").alias("bands")), "nodes")
    member = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    low = member.groupBy("band", "hash").agg(F.min("node").alias("v"), F.max("node").alias("top")).filter("v < top")
    ties = member.join(low.drop("top"), ["band", "hash"]).select(F.col("node").alias("u"), "v").filter("u <> v")
    found = components(ties, stored, "candidates")

    sized = found.join(nodes.select("node", "copies", "first_id", "n_chars"), "node")
    blocks = sized.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_chars") / BLOCK_CHARS)).alias("blocks"))
    cands = stored.put(
        sized.join(blocks, "root").select("node", "root", "copies", "first_id", "blocks",
                                          F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")), "members")

    texts = _one_text_per_task(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    # a merge join at every size: what the texts cost in the shuffle grows with the input and never jumps
    own = (texts.join(cands.withColumnRenamed("node", "cand").hint("merge"),
                      (F.col("node") == F.col("cand")) & F.col("doc_id").eqNullSafe(F.col("first_id"))))
    met = own.select("root", "node", "copies", "block", "text",
                     F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("with"))
    met = met.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node",
                     "copies", "block", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verified = stored.put(
        met.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
        .mapInArrow(_verify(threshold, n), "node bigint, links bigint, other bigint"), "verified")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(verified.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")),
                        stored, "classes")
    every = (nodes.select("node", "copies", "first_id")
             .join(links, "node", "left").join(groups, "node", "left")
             .filter("copies > 1 or links > 0")
             .select("node", "first_id", F.coalesce("root", "node").alias("class_node"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    every = stored.put(every, "linked")
    ids = every.groupBy("class_node").agg(F.min("first_id").alias("class_id"))
    return every.join(ids, "class_node").select("node", "class_node", "class_id", "n_links")


def _one_text_per_task(docs: DataFrame) -> DataFrame:
    """``node``, ``doc_id``, ``text``: of the rows of a task that agree in node and id only the first."""
    get_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [_node(words_of(t)) for t in b.column(1).to_pylist()]
            keep = []
            for i, key in enumerate(zip(found, ids, strict=True)):
                if key[0] is not None and key not in seen:
                    seen.add(key)
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()).take(take), b.column(0).take(take), b.column(1).take(take)],
                names=["node", "doc_id", "text"])

    schema = T.StructType([T.StructField("node", T.LongType()), *docs.schema.fields])
    return docs.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL, n: int = NGRAM) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, ``n_links`` (other rows it is linked to)."""
    stored = Stored(get_ready(docs.sparkSession), "ngram-join")
    sketched = stored.put(sketch(docs, id_col, text_col, threshold, recall, n), "sketch")
    linked = classes(docs, sketched, stored, text_col, id_col, threshold, n)
    return sketched.select("doc_id", "node").join(linked, "node", "left").select(
        "doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row of each class: the one with the smallest id, then the smallest hash."""
    stored = Stored(get_ready(docs.sparkSession), "ngram-join")
    sketched = stored.put(sketch(docs, id_col, text_col, **options), "sketch")
    linked = classes(docs, sketched, stored, text_col, id_col)
    # whole rows meet their class by a merge join at every size, like the candidate texts above
    marked = with_node(docs, text_col).join(linked.drop("n_links").hint("merge"), "node", "left")
    # only rows that carry the class's id can stay; where several do, partial aggregation leaves one per task
    alone = marked.filter(F.col("class_node").isNull()).select("row.*")
    chosen = (marked.filter(F.col("class_node").isNotNull() & F.col("row")[id_col].eqNullSafe(F.col("class_id")))
              .groupBy("class_node").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")))
    return alone.union(chosen.select("row.*"))
