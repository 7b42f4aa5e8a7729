"""Alignment of two tokenizers against a whole-text brute force; the merge; odd tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import alignment
from rollcall.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def links_of(text):
    """Tokens of the whole text on both sides, groups by common ends, all pairs of each group."""
    pair = alignment.pair_of(A, B)
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    a_bytes, b_bytes, want = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b], (" " + text).encode()
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
    common = np.intersect1d(ends_a, ends_b)
    groups = [([], []) for _ in common]
    for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
        for i, g in zip(ids, np.searchsorted(common, ends), strict=True):
            groups[g][side].append(i)
    return a, b, groups


def brute(docs):
    found, counts = [], Counter()
    for d, t in docs:
        value = links_of(t) if t else None
        a, b, groups = value or ([], [], [])
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        counts.update(links.keys())
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((d, len(a), len(b), len(groups), hashlib.sha256(text.encode()).hexdigest() if a else "", links))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted((d, n_a, n_b, n_g, sum(x.values()), sum(m for p, m in x.items() if counts[p] == best[p[0]]),
                   sum(m * counts[p] for p, m in x.items()), sha) for d, n_a, n_b, n_g, sha, x in found)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\tÉ.'s1漢▁", max_size=50)))
def test_stretches_align_like_the_whole_text(text):
    value = next(alignment.pair_of(A, B).documents([text]))
    want = links_of(text) if text else None
    if want is None:
        assert value is None
        return
    groups, links, n_a, n_b, n_groups, more = value
    assert groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want[2])
    got = Counter(np.frombuffer(links, "<u4").tolist())
    for pairs, times in more or ():
        got.update(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
    assert got == Counter(i << alignment.B_BITS | j for x, y in want[2] for i in x for j in y)
    assert (n_a, n_b, n_groups) == (len(want[0]), len(want[1]), len(want[2]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 50), st.integers(1, 9), max_size=20), max_size=6), st.integers(1, 7))
def test_merge_adds_equal_pairs(streams, block):
    total = Counter()
    for s in streams:
        total.update(s)
    arrays = [(np.array(sorted(s), np.int64), np.array([s[k] for k in sorted(s)], np.int64)) for s in streams]
    pairs, counts = alignment.merge(arrays, block)
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == total and pairs.tolist() == sorted(total)


def test_many_runs_and_odd_texts(spark):
    texts = ["plain words here", None, "", "two  gaps\n\nand\ttabs ", "\nfirst line", "<|endoftext|> stays", "漢字かな交じり文" * 40,
             "qzx" * 700, "a ▁ b", "words " * 500, "no break", "x\r\ny"] * 3
    docs = spark.createDataFrame([(i % 7, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, run string, kind int")
    got = alignment.align(docs.repartition(3), A, B, run_links=50, radixes=4).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute([(i % 7, t) for i, t in enumerate(texts)])


def test_long_groups_keep_their_times(spark):
    left, right = [1, 2, 1, 3], [5, 5, 6]
    pairs, times = alignment._outer(left, right)
    assert Counter(dict(zip(pairs.tolist(), times.tolist(), strict=True))) == Counter(i << alignment.B_BITS | j for i in left for j in right)
    parts = list(alignment.runs([np.array([7 << 16 | 1])], [(np.array([7 << 16 | 1, 9 << 16 | 0]), np.array([300, 2]))], 1))
    place, times = alignment._unsqueeze(parts[0][2])
    assert (place.tolist(), times.tolist()) == ([1, 0], [301, 2])


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_query_on_the_documents(spark):
    got = QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == brute([tuple(d) for d in docs])
