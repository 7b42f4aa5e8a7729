"""Edited token counts against a full recount."""

import random

import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPLIT = regex.compile(public_tokenizers.PATTERN)
COUNT = token_counts.counter(RANKS, public_tokenizers.PATTERN)


def whole(text):
    return sum(COUNT(m[0]) for m in SPLIT.finditer(text))


def check(tree):
    assert "".join(m[0] for m in SPLIT.finditer(tree.text)) == tree.text
    assert tree.tokens == whole(tree.text)
    assert sum(x.chars for x in tree.leaves) == len(tree.text)
    assert [p for x in tree.leaves for p in x.pieces] == [(len(m[0]), COUNT(m[0])) for m in SPLIT.finditer(tree.text)]


ALPHABET = st.text(alphabet="ab 's\n\t1é.,'rel  ", max_size=40)


@settings(max_examples=150, deadline=None)
@given(ALPHABET, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20), ALPHABET), max_size=6))
def test_small_texts(text, edits):
    tree = token_counts.TokenTree(text, SPLIT, COUNT)
    check(tree)
    for start, size, new in edits:
        start = min(start, len(tree.text))
        tree.edit(start, start + size, new)
        check(tree)


def test_long_text_encodes_only_near_the_edit():
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beta", "don't", "été", "  x", "12", "\n\n"]) for _ in range(20000))
    tree = token_counts.TokenTree(text, SPLIT, COUNT)
    for _ in range(60):
        at = rng.randrange(len(tree.text))
        before = tree.encoded
        tree.edit(at, at + rng.randrange(8), rng.choice(["", "q", " new words here", "'s"]))
        assert tree.encoded - before < 40
        assert tree.tokens == tree.levels[-1][0][1]
    check(tree)


def test_table_cases(spark):
    rows = [(1, "one two three", [(4, 7, "2")], "x"), (1, "one two three", [(4, 7, "2")], "x"), (2, None, None, "x"),
            (3, "", [(0, 0, "new")], None), (4, "abc", [(9, 12, "z"), (None, 1, "z"), (3, 99, None)], "x"),
            (None, "word " * 30000, [(75000, 75001, "#")], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>, "
                                     "n_after string")
    out = token_counts.recount(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == 6
    for r in out:
        assert r.n_after == whole(r.edited) and r.n_before == whole(r.row.text or "")
    by = {r.row.doc_id: r for r in out}
    assert by[4].n_skipped == 2 and by[4].edited == "abc" and by[3].edited == "new"
    assert by[None].n_encoded < 20 and by[2].n_after == 0
    assert by[1].row.n_after == "x"
    empty = token_counts.recount(df.limit(0), RANKS, public_tokenizers.PATTERN)
    assert empty.count() == 0
