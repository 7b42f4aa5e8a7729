"""Packing: ids against the whole library, gapless sequences, few sequences, odd tables."""

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import packing
from rollcall.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return packing.words_encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abÉß '.,!?s\nt<|>İΣ1́", max_size=60)))
def test_stretches_encode_like_the_whole_text(text):
    assert np.frombuffer(next(packing.token_bytes([text], PATH)), "<u4").tolist() == whole(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_takes_the_least_room(lengths):
    bins, places, fill = packing.best_fit(np.array(lengths, np.int64), 64)
    rooms = []
    for n, b, place in zip(lengths, bins.tolist(), places.tolist(), strict=True):
        fitting = [r for r in rooms if r >= n]
        assert (b < len(rooms) and rooms[b] == min(fitting)) if fitting else b == len(rooms)
        if b == len(rooms):
            rooms.append(64)
        assert place == 64 - rooms[b]
        rooms[b] -= n
    assert fill.tolist() == [64 - r for r in rooms]


def check_rows(rows, texts, size):
    by_doc = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = []
    for d, t in texts:
        ids = np.array([*whole(t or ""), 0], "<u4")
        expected += [(d, k, at, len(ids[at:at + size]), zlib.crc32(ids[at:at + size].tobytes()))
                     for k, at in enumerate(range(0, len(ids), size))]
    assert by_doc == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(sequences)


def test_levels_pack_tightly(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["plain", "words", "É1", "x.y"]) for _ in range(rng.choice([0, 3, 9, 14, 40])))) for i in range(400)]
    texts += [(5, "the same row"), (5, "the same row"), (None, None), (7, "a" * 3000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, length int")
    rows = packing.pack(docs.filter("doc_id IS NOT NULL"), PATH, size=32, leaf=30, fan=3, slack=1).collect()
    n = check_rows(rows, texts[:-2] + texts[-1:], 32)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 32) + 1


def test_items_that_never_fit_together(spark):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(120)], "doc_id long, text string")
    rows = packing.pack(docs, PATH, size=32, leaf=10, fan=4).collect()
    assert check_rows(rows, [(i, "word " * 20) for i in range(120)], 32) == 120


def test_empty_table_and_null_id(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    row = packing.pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), PATH).first()
    assert (row.doc_id, row.piece, row.start, row.length, row.offset) == (None, 0, 0, 1, 0)


def test_query_on_the_documents(spark):
    rows = QUERIES["op11_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    n = check_rows(rows, [tuple(d) for d in docs], 2048)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1
