"""The pipeline's stages, one after the other, against plain versions of the same decisions."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline as p
from rollcall.llm import bpe, ngram_join, secret_scan
from rollcall.llm.common import words_of

SF = "/root/testdata/sf0.001"


def windows(words, n=10):
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "row")
    odd = spark.createDataFrame([(90001, None, "x", "s", 0), (90002, "", "x", "s", 0), (None, "null id", None, None, None)],
                                docs.schema)
    docs = docs.union(odd)
    seen = [r.asDict() for r in docs.collect()]
    bench = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        rows = [r.asDict() for r in out.collect()]
        if name == "byte_level_bpe":
            break
        assert out.columns == docs.columns
        kept = {r["doc_id"] for r in rows}
        if name == "toxicity":
            assert {90001, 90002} <= kept and len(rows) >= 0.8 * len(seen)
        if name == "ngram_jaccard_join":
            links = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
            assert kept == {i for i, r in links.items() if not r.n_links or r.class_id == i} and len(rows) == len(kept)
        if name == "benchmark_decontamination":
            parts = {w for b in bench for w in windows(b)}
            sizes = {len(w) for w in parts}
            for r in seen:
                words = words_of(r["text"])
                hit = any(w in parts for n in sizes if len(words) >= n for w in windows(words, n))
                assert (r["doc_id"] in kept) != hit
        if name == "secret_scans":
            assert {r["doc_id"]: r["text"] for r in rows} == {r["doc_id"]: secret_scan.blank(r["text"], "[SECRET]") for r in seen}
        docs, seen = spark.createDataFrame(out.collect(), out.schema), rows
    enc = bpe.encoder(public_tokenizers.path(p.RANK_FILE), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] or "" for r in seen}
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
    want = sorted(map(tuple, docs.collect()))
    got = p.run(spark, SF)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == want and want
    with pytest.raises(Exception, match="no-such"):
        p.run(spark, "/tmp/no-such-folder")


def test_empty_tables_repeated_rows_and_a_long_text(spark, scratch):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{scratch}/empty/{name}.parquet")
    assert p.run(spark, f"{scratch}/empty").count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{scratch}/odd/{name}.parquet")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, "the same row twice", "x", "s", 18)] * 2 + [(2, "long word " * 60_000, "x", "s", 600_000), (3, None, "x", "s", 0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{scratch}/odd/documents.parquet")
    assert sorted(r.doc_id for r in p.run(spark, f"{scratch}/odd").collect()) == [1, 2, 3]
