"""Tree search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import vector_search as v


def brute(ids, x, queries, k):
    out = {}
    for q, qv in queries:
        d = np.sqrt(((x - qv) ** 2).sum(axis=1))
        out[q] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def test_tree_files_and_visits_every_leaf_once():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    tree = v.fit_tree(x)
    leaf = tree.file(x)
    assert tree.leaves > 12 and set(leaf) <= set(range(tree.leaves))
    order = list(tree.visits(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == leaf[0]


def test_recall_and_order(spark):
    out = v.search(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), F.col("vec_id") % 20 == 0).toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, [(int(i), x[n]) for n, i in enumerate(ids) if i % 20 == 0], 10)
    hits = 0
    for q, near in want.items():
        got = out[out.query_id == q].sort_values("rank")
        assert list(got["rank"]) == list(range(1, 11))
        hits += len({i for i, _ in near} & set(got.vec_id))
        true = dict(near)
        assert all(abs(true[i] - s) < 1e-12 for i, s in zip(got.vec_id, got.score, strict=True) if i in true)
    assert len(out) == 10 * len(want) and hits / (10 * len(want)) >= 0.9


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    copies = [(i, [1.0, 0.0, 0.0]) for i in range(100, 130)]
    rows = [(0, [1.0, 0.0, 0.0]), (20, [0.9, 0.1, 0.0]), (20, [0.9, 0.1, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [nan, 1.0, 1.0]),
            (4, [inf, 1.0, 1.0]), (5, [1.0, None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0, 1.0]), *copies]
    df = spark.createDataFrame([(i, e, 9) for i, e in rows], "vec_id long, embedding array<double>, rank int")
    out = v.search(df, F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    assert set(out.query_id) == {0, 20, 100, 120}
    assert list(out[out.query_id == 0].vec_id) == list(range(100, 110))          # ties to the smaller id
    assert list(out[out.query_id == 100].vec_id) == [0, *range(101, 110)]
    assert list(out[out.query_id == 20].vec_id) == [0, *range(100, 109)]
    assert out[out.query_id == 20].score.iloc[0] == pytest.approx(np.sqrt(0.01 + 0.01), abs=1e-15)
    few = v.search(df.filter("vec_id in (0, 20, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 20), (20, 1, 0)]
    assert v.search(df.limit(0), F.lit(True)).count() == 0


def test_ids_of_equal_vectors_are_cut_while_they_are_gathered(spark):
    rows = spark.range(20000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.0), F.lit(1.0)))
                                     .when(F.col("id") % 3 == 1, F.array(F.lit(-0.0), F.lit(1.0)))
                                     .otherwise(F.array(F.lit(2.0), (F.col("id") % 10).cast("double"))).alias("v"))
    out = v._smallest_ids(rows.unionByName(rows), 4)
    got = {tuple(r.v): r.ids for r in out.collect()}
    want = {(0.0, 1.0): [0, 1, 3, 4]}
    for i in range(2, 20000, 3):
        want.setdefault((2.0, float(i % 10)), []).append(i)
    assert got == {k: ids[:4] for k, ids in want.items()} and out.count() == len(want)
    assert "collect_" not in out._jdf.queryExecution().optimizedPlan().toString()
