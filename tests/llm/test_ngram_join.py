"""Near-duplicate classes and link counts against all pairs compared directly."""

import random

import numpy as np

from rollcall.llm import ngram_join as j
from rollcall.llm.common import words_of


def grams(text):
    w = words_of(text)
    n = min(j.NGRAM, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def by_pairs(rows, threshold=0.8):
    """(class id, links) per row, by comparing every two rows."""
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((d, ids.get(find(i)) if links[i] else d, links[i]) for i, (d, _) in enumerate(rows) if d is not None)


def made_rows():
    rng = random.Random(5)
    def word():
        return "".join(rng.choices("abcdefghij", k=4))
    rows, at = [], 0
    for size in (1, 2, 3, 9, 150):                  # the last group spans several blocks
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((at, " ".join(w) + rng.choice(["", ".", " !"])))
            at += 1
    rows += [(at, rows[3][1].upper()), (at + 1, rows[3][1]), (at + 1, rows[3][1]), (at + 2, None), (at + 3, ""), (at + 4, "..."),
             (at + 5, "two words"), (at + 6, "Two words!"), (at + 7, "a b c d e"), (at + 8, "long " * 30000)]
    passage = " ".join(word() for _ in range(60))   # shared by texts that are no near copies
    rows += [(at + 20 + i, passage + " " + " ".join(word() for _ in range(80))) for i in range(8)]
    return rows


def test_classes_equal_direct_comparison(spark):
    rows = made_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    out = j.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == by_pairs(rows)
    kept = j.one_of_each(df)
    assert kept.columns == df.columns
    classes = {r.class_id for r in out if r.n_links} | {r.doc_id for r in out if not r.n_links}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    assert all(r.node == 1 for r in kept.collect())


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "same text here"), (None, "same text here"), (3, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_links) for r in j.near_duplicates(df).collect()) == [(0, 1), (0, 1), (3, 0)]
    assert j.one_of_each(df).count() == 2
    assert j.near_duplicates(df.limit(0)).count() == j.one_of_each(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands = j.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8 ** j.BAND_ROWS) ** bands >= 0.999 > 1 - (1 - 0.8 ** j.BAND_ROWS) ** (bands - 1)


def test_sketch_does_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 700, 3, 90, 2)]
    whole = j.Sketcher(4, 3).band_hashes(sets)
    monkeypatch.setattr(j, "_CHUNK", 64)
    assert (j.Sketcher(4, 3).band_hashes(sets) == whole).all()
    assert (j.Sketcher(4, 3).band_hashes(sets[1:2]) == whole[1:2]).all()


def test_similar_counts_every_allowed_pair():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(30) for _ in range(25)], np.uint64)) for _ in range(12)]
    left = np.array([i < 6 for i in range(12)])
    got = j._similar(sets, left, ~left, 0.5)
    for a in range(12):
        for b in range(12):
            both = len(np.intersect1d(sets[a], sets[b]))
            want = left[a] != left[b] and both / (len(sets[a]) + len(sets[b]) - both) >= 0.5
            assert got[a, b] == want
