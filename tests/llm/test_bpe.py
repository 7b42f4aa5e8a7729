"""Byte-level BPE against the library on whole texts, and round trips."""

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.integers(1, 20))
def test_parts_encode_like_the_whole(text, size):
    enc = bpe.encoder(RANKS, PATTERN)
    pieces = list(bpe.parts(text, size))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab c1'st\n\t .é", max_size=200))
def test_parts_on_dense_boundaries(text):
    enc = bpe.encoder(RANKS, PATTERN)
    assert [i for p in bpe.parts(text, 1) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_table_cases(spark):
    texts = ["plain words", "", None, "<|endoftext|> stays text", "naïve ☃ 漢字 " * 5, "word " * 40000, "x" * 3000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts + texts[:1])], "doc_id long, text string, ids string")
    coded = bpe.encode(df, RANKS, PATTERN).selectExpr("row.doc_id", "row.text", "row.ids AS other", "ids")
    out = {r.doc_id: r for r in bpe.decode(coded, RANKS, PATTERN).withColumn("joined", bpe.ids_text("ids")).collect()}
    enc = bpe.encoder(RANKS, PATTERN)
    for i, t in enumerate(texts):
        if t is None:
            assert out[i].ids is None and out[i].decoded is None
        else:
            assert out[i].ids == enc.encode_ordinary(t) and bytes(out[i].decoded) == t.encode()
            assert out[i].joined == ",".join(map(str, out[i].ids))
        assert out[i].other == "clash"
    assert out[len(texts)].ids == out[0].ids
    assert bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0


def test_query_digests(spark):
    from rollcall.llm.queries import QUERIES
    out = QUERIES["op9_byte_bpe"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    enc = bpe.encoder(RANKS, PATTERN)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(out)
    for r in rows:
        ids = enc.encode_ordinary(r.text or "")
        got = out.loc[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_round_trip_equals_encode_then_decode(spark):
    texts = ["plain words", "", None, "<|endoftext|>", "漢字 ☃ " * 9, "word " * 40000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, *texts])], "doc_id long, text string, decoded string")
    both = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    once = bpe.round_trip(df, RANKS, PATTERN)
    assert once.schema == both.schema
    key = lambda r: r.row.doc_id
    assert sorted(once.collect(), key=key) == sorted(both.collect(), key=key)
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0
