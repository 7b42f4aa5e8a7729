"""Approximate nearest neighbours: a hierarchical k-means tree, best bin first.

The tree is fitted in numpy on a bounded sample and sent to the executors;
every vector is filed under its leaf.  A query walks the tree with a priority
queue: the nearest child is followed, the others wait in the queue, and the
branch with the smallest distance is taken up next, leaf after leaf.  A branch
waits under a lower bound for its members' distance: the distance from the
query to its cell wall, as known from the way down.

How many leaves a query visits is not fixed: calibration queries are answered
by brute force over all vectors, and the visit order says at which visit each
true neighbour would have been found.  The visits are widened until the share
found reaches the target recall, plus a reserve.

Equal vectors are one candidate with the smallest ids among them (as many as a
result can use), so a vector that a third of all rows share costs as much as
any other.  Exact distances decide the order: Euclidean, double precision, on
the original vectors, ties to the smaller id.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, neither do rows without an id; a vector whose length
differs from the most frequent one takes no part; rows of one id are the same
candidate if their vectors are equal, and separate ones otherwise; a query is
never its own neighbour (no row with its id is); with fewer candidates than
asked, all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import Stored, get_ready

SAMPLE = 20_000             # vectors the tree is fitted on, in the order of a hash
BRANCH = 8                  # children of a node
LEAF_SAMPLE = 160           # sample vectors up to which a node is a leaf
ROUNDS = 8                  # Lloyd rounds per node
CALIBRATION = 48            # queries answered by brute force
TARGET_RECALL = 0.97
SALTS = 64                  # among which the batches' ids of one vector are dealt first
SLOT = 4096                 # vectors of a leaf that one group holds


@dataclass
class Tree:
    """Nodes as arrays: children of node i are first[i] .. first[i] + count[i] - 1; leaves have count 0."""
    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray        # leaf number or -1

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector: the nearest child on each level."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.count[node] > 0)
            if not len(inner):
                return self.leaf[node]
            for parent in np.unique(node[inner]):
                rows = inner[node[inner] == parent]
                kids = np.arange(self.first[parent], self.first[parent] + self.count[parent])
                node[rows] = kids[_nearest(x[rows], self.centre[kids])]

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        heap = [(0.0, 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            while self.count[node]:
                kids = np.arange(self.first[node], self.first[node] + self.count[node])
                d = ((self.centre[kids] - q) ** 2).sum(axis=1)
                best = int(d.argmin())
                # distance to the wall between the nearest child and each other one
                gap = np.sqrt(np.maximum(((self.centre[kids] - self.centre[kids[best]]) ** 2).sum(axis=1), 1e-30))
                wall = (d - d[best]) / (2 * gap)
                for k, w in zip(kids.tolist(), wall.tolist(), strict=True):
                    if k != kids[best]:
                        heapq.heappush(heap, (max(bound, w), k))
                node = int(kids[best])
            yield int(self.leaf[node])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def fit_tree(x: np.ndarray, seed: int = 5) -> Tree:
    """Hierarchical k-means over distinct sample vectors."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0) if len(x) else x
    centre, first, count, leaf = [x.mean(axis=0)], [0], [0], [-1]
    todo, leaves = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        k = min(BRANCH, len(rows) // (LEAF_SAMPLE // 2))
        parts: list[np.ndarray] = []
        if len(rows) > LEAF_SAMPLE and k > 1:
            c = x[rng.choice(rows, k, replace=False)]
            for _ in range(ROUNDS):
                near = _nearest(x[rows], c)
                c = np.stack([x[rows[near == i]].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
            near = _nearest(x[rows], c)
            parts = [rows[near == i] for i in range(k) if (near == i).any()]
            c = c[[i for i in range(k) if (near == i).any()]]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        first[node], count[node] = len(centre), len(parts)
        for part, mean in zip(parts, c, strict=True):
            todo.append((len(centre), part))
            centre.append(mean)
            first.append(0)
            count.append(0)
            leaf.append(-1)
    return Tree(np.stack(centre), np.array(first), np.array(count), np.array(leaf))


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
           target: float = TARGET_RECALL) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of every row that ``is_query`` marks."""
    spark = get_ready(df.sparkSession)
    stored = Stored(spark, "vector-search")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"),
                     is_query.alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not size:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == size[0]["n"])

    # one row per distinct vector with the k + 1 smallest ids: no result needs more of them
    points = stored.put(_smallest_ids(rows.select("vec_id", "v"), k + 1), "points")
    queries = stored.put(rows.filter("q").select(F.col("vec_id").alias("query_id"), "v").distinct(), "queries")
    sample = _matrix(pa.chunked_array(
        points.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("v").chunks).combine_chunks())
    tree = fit_tree(sample)
    sent = spark.sparkContext.broadcast(tree)            # bounded by SAMPLE vectors

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = sent.value.file(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=["ids", "v", "leaf"])

    filed = stored.put(points.select("ids", "v").mapInArrow(file, "ids array<bigint>, v array<double>, leaf bigint"),
                       "filed")
    visits = _calibrated(filed, queries, tree, k, target, spark)
    # a leaf's vectors are dealt into slots of bounded size; one row per leaf, so no more than SAMPLE rows
    slots = filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / SLOT).alias("slots"))
    slots_of = spark.sparkContext.broadcast({r["leaf"]: r["slots"] for r in slots.collect()})

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            take, leaves, places = [], [], []
            for i in range(b.num_rows):
                for n, leaf in enumerate(sent.value.visits(x[i])):
                    if n >= visits:
                        break
                    for slot in range(slots_of.value.get(leaf, 0)):
                        take.append(i)
                        leaves.append(leaf)
                        places.append(slot)
            idx = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves, pa.int64()), pa.array(places, pa.int64()), b.column(0).take(idx), b.column(1).take(idx)],
                names=["leaf", "slot", "query_id", "v"])

    dealt = filed.join(F.broadcast(slots), "leaf").select(
        "leaf", F.pmod(F.xxhash64("v"), F.col("slots")).alias("slot"), F.lit(0).alias("side"),
        F.lit(None).cast("bigint").alias("query_id"), "ids", "v")
    asked = queries.mapInArrow(plan, "leaf bigint, slot bigint, query_id bigint, v array<double>").select(
        "leaf", "slot", F.lit(1).alias("side"), "query_id", F.lit(None).cast("array<bigint>").alias("ids"), "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = (dealt.unionByName(asked).repartition(parts, "leaf", "slot").sortWithinPartitions("leaf", "slot", "side")
           .mapInArrow(_nearest_in_slot(k), "query_id bigint, near array<struct<score:double,vec_id:bigint>>"))
    best = met.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    found = best.select("query_id", F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"),
        F.col("n.score").alias("score"))
    return found


def _smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """``ids`` (the ``most`` smallest, ascending) and ``v`` per distinct vector.

    No list grows with the number of equal vectors: a task cuts each vector's ids down batch by batch before they
    are dealt, and again while the sorted rows of a vector pass by, first per salt and then per vector."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "ids array<bigint>, v array<double>, salt bigint"
    first = rows.select("vec_id", "v").mapInArrow(_cut_in_batches(most), schema)
    some = (first.repartition(parts, "v", "salt").sortWithinPartitions("v", "salt")
            .mapInArrow(_cut_sorted(most, True), schema))
    return (some.repartition(parts, "v").sortWithinPartitions("v")
            .mapInArrow(_cut_sorted(most, False), schema).select("ids", "v"))


def _id_rows(ids: list[list[int]], v: pa.Array, salt: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), v, pa.array(salt, pa.int64())],
                                      names=["ids", "v", "salt"])


def _cut_in_batches(most: int):
    """The ``most`` smallest ids per vector of a batch, with a salt of the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found: dict[bytes, tuple[int, set]] = {}
            x = _matrix(b.column(1)) + 0.0          # 0 and -0 are one value
            for i, vec_id in enumerate(b.column(0).to_pylist()):
                found.setdefault(x[i].tobytes(), (i, set()))[1].add(vec_id)
            ids = [sorted(s)[:most] for _, s in found.values()]
            yield _id_rows(ids, pa.array(list(x[[i for i, _ in found.values()]]), pa.list_(pa.float64())),
                           [s[0] * 2654435761 % 2 ** 32 % SALTS for s in ids])

    return run


def _cut_sorted(most: int, by_salt: bool):
    """The same over sorted rows; holds ``most`` ids of one vector at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, last = None, [], None
        for b in batches:
            out_ids, out_salt, out_v = [], [], []
            x, lists, salts = _matrix(b.column(1)), b.column(0).to_pylist(), b.column(2).to_pylist()
            for i in range(b.num_rows):
                k = (x[i].tobytes(), salts[i] if by_salt else 0)
                if k != key:
                    if key is not None:
                        out_ids.append(ids)
                        out_salt.append(key[1])
                        out_v.append(last)
                    key, ids, last = k, [], x[i].copy()
                ids = sorted({*ids, *lists[i]})[:most]
            if out_ids:
                yield _id_rows(out_ids, pa.array(out_v, pa.list_(pa.float64())), out_salt)
        if key is not None:
            yield _id_rows([ids], pa.array([last], pa.list_(pa.float64())), [key[1]])

    return run


def exact_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _nearest_in_slot(k: int):
    """Streams the sorted rows of a task; of a slot it holds the vectors, of the queries one at a time."""
    kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, x = None, [], [], None
        for b in batches:
            out_q, out_n = [], []
            leaf, slot, side, query = (b.column(i).to_pylist() for i in range(4))
            id_lists, m = b.column(4).to_pylist(), _matrix(b.column(5))
            for i in range(b.num_rows):
                if (leaf[i], slot[i]) != key:
                    key, ids, vectors, x = (leaf[i], slot[i]), [], [], None
                if side[i] == 0:
                    ids.append(id_lists[i])
                    vectors.append(m[i])
                elif vectors:
                    if x is None:
                        x = np.stack(vectors)
                    d = exact_distances(m[i], x)
                    take = min(len(d), k + 1)
                    limit = np.partition(d, take - 1)[take - 1]
                    near = sorted((float(d[j]), v) for j in np.flatnonzero(d <= limit).tolist() for v in ids[j]
                                  if v != query[i])[:k]
                    if near:
                        out_q.append(query[i])
                        out_n.append([{"score": s, "vec_id": v} for s, v in near])
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_n, kind)],
                                             names=["query_id", "near"])

    return run


def _calibrated(filed: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float, spark) -> int:
    """Leaf visits that find the share ``target`` of the true neighbours of the calibration queries."""
    chosen = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).collect()
    if not chosen:
        return 1
    ask = spark.sparkContext.broadcast([(r["query_id"], np.array(r["v"])) for r in chosen])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in ask.value]
        for b in batches:
            x, leaf, ids = _matrix(b.column(1)), b.column(2).to_pylist(), b.column(0).to_pylist()
            if not len(x):
                continue
            for n, (query, q) in enumerate(ask.value):
                d = exact_distances(q, x)
                take = min(len(d), k + 1)
                near = np.argpartition(d, take - 1)[:take]
                best[n] = sorted(best[n] + [(float(d[j]), v, leaf[j]) for j in near.tolist() for v in ids[j]
                                            if v != query])[:k]
        rows = [(n, *r) for n, found in enumerate(best) for r in found]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["n", "score", "vec_id", "leaf"])

    every = filed.mapInArrow(brute, "n bigint, score double, vec_id bigint, leaf bigint")
    top = every.groupBy("n").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id", "leaf"))), 1, k)
                                 .alias("near")).collect()
    places = []
    for r in top:
        order = {leaf: i + 1 for i, leaf in enumerate(tree.visits(ask.value[r["n"]][1]))}
        places += [order[x["leaf"]] for x in r["near"]]
    if not places:
        return 1
    need = sorted(places)[min(len(places), math.ceil(target * len(places))) - 1]
    return min(tree.leaves, need + max(1, need // 10))
