"""Exact base scores, and a model whose probabilities add up."""

import math
import zlib
from collections import Counter

import numpy as np

from rollcall.llm import lm_score as m


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(m.ROWS, m.WIDTH)).astype(np.float32)
    for two, one in ((m.START, m.START), (m.START, 5), (17, m.SYMBOLS - 1)):
        events = (two << 24) | (one << 12) | np.arange(m.SYMBOLS)
        assert abs(np.exp(m.log_probabilities(weights, events)).sum() - 1) < 1e-4


def test_events_do_not_cross_texts():
    symbol, ends = np.array([5, 6, 7, 8, 9]), np.array([3, 4, 5])
    got = [(int(e) >> 24, int(e) >> 12 & 0xFFF, int(e) & 0xFFF) for e in m.events(symbol, ends)]
    s = m.START
    assert got == [(s, s, 5), (s, 5, 6), (5, 6, 7), (s, s, 8), (s, s, 9)]


def test_groups_agree(spark):
    pairs = [0, 1, (m.START << 12) | m.START, 4711, (900 << 12) | 3]
    df = spark.createDataFrame([(p,) for p in pairs], "p long")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(m.group_of(F.col("p"))).collect()] == [int(m.group_of(np.int64(p))) for p in pairs]
    tokens = ["a", "ab", "abc", "wörter", "é", "漢字", "\n"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert [r[0] for r in df.select(m.tail_symbol_column(F.col("t"))).collect()] == [m.tail_symbol(t.encode()) for t in tokens]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(m, "KEPT", 1 << 10)         # most tokens' counts come by the join
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(900001, None, "x"), (900002, "", "x"), (None, "İ K a b", "x"),
                                   (900003, "the " * 30000, "x"), (900003, "the " * 30000, "x")], "doc_id long, text string, lang string")
    df = docs.union(extra).withColumnRenamed("lang", "score")
    rows = df.select("doc_id", "text").collect()
    out = m.score(df).collect()
    assert len(out) == len(rows)

    def tokens(text):
        return [w for w in (text or "").encode().lower().split()] + [b"\n"]

    def fold(doc_id):
        return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7

    c = Counter(t for r in rows if fold(r.doc_id) != 2 for t in tokens(r.text))
    total, room = sum(c.values()), sum(c.values()) + len(c) + 1
    want = sorted((r.doc_id or 0, len(tokens(r.text)), sum(t in c for t in tokens(r.text)),
                   round(sum(math.log10((c[t] + 1) / room) for t in tokens(r.text)), 5)) for r in rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out) == want
    assert {r.train_tokens for r in out} == {total} and all(r.held_out == (fold(r.doc_id) == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert m.score(df.limit(0)).count() == 0
