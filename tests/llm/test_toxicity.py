"""Toxicity: held-out accuracy, unseen misspellings and defined cases."""

import random

import numpy as np

from rollcall.llm import toxicity as x


def made(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(2, 9))) for _ in range(400)]
    bad = ["stupid", "worthless", "pathetic"]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 400))]
        label = int(i % 4 == 0)
        if label:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((" ".join(w), label))
    return rows, plain


def test_held_out_accuracy_and_misspellings():
    rows, plain = made(900, 1)
    model = x.fit(iter(rows[:700]))
    again = x.Model.from_bytes(model.to_bytes())
    scorer = x.Scorer(again)
    got = np.array([scorer(t) >= x.THRESHOLD for t, _ in rows[700:]])
    y = np.array([v == 1 for _, v in rows[700:]])
    assert (got == y).mean() > 0.9
    clean = " ".join(plain[:60])
    for word in ("stuupid", "worthles", "patheticc", "stup1d", "w0rthless"):
        assert word not in ("stupid", "worthless", "pathetic")
        assert scorer(f"{clean} {word} {clean}") > 2 * scorer(f"{clean} {plain[7]} {clean}")
    assert scorer("") == scorer(None) == scorer("12 34 !") == 0
    long = " ".join(random.Random(3).choices(plain, k=2000))
    assert 0 <= scorer(long) < x.THRESHOLD <= scorer(long + " stupid worthless pathetic")


def test_tables(spark):
    rows, _ = made(300, 2)
    docs = spark.createDataFrame([(i, t, 0.5) for i, (t, _) in enumerate(rows)] + [(None, "stupid", 0.1), (5, None, 0.1)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)] + [(1, None), (None, 1), (2, rows[2][1])],
                                   "doc_id long, toxic int")
    model = x.train(docs, labels)
    out = x.score(docs, model).select("row.doc_id", "row.score", "score").collect()
    assert len(out) == 302 and all(0 <= r[2] <= 1 for r in out) and out[0][1] == 0.5
    kept = x.clean_rows(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in out if r[2] < x.THRESHOLD}
    none = x.train(docs, labels.limit(0))
    assert {r.score for r in x.score(docs, none).select("score").collect()} == {0.0}
    assert x.score(docs.limit(0), model).count() == 0


def test_segments_overlap_by_half_and_cover_every_word():
    bags = x.Bags()
    for n in (1, 7, 8, 9, 16, 17, 40, 41):
        bags.add(" ".join("abcdefgh"[i % 8] for i in range(n)), 0)
    bags.close()
    rng = np.random.default_rng(3)
    m = x.Model(rng.normal(size=(x.BUCKETS, x.DIM)).astype(np.float32), rng.normal(size=(x.DIM, 2)).astype(np.float32),
                np.zeros(2, np.float32), (1.0, 0.0, 0.0))
    single, got = bags.word_scores(m)[bags.word_flat], bags.segment_scores(m)
    begin = np.concatenate(([0], np.cumsum(bags.word_counts)))
    for doc in range(len(bags.labels)):
        of = range(bags.doc_first[doc], bags.doc_first[doc + 1])
        spans = [(bags.seg_start[k], bags.seg_start[k] + bags.seg_len[k]) for k in of]
        assert set(range(begin[doc], begin[doc + 1])) == {p for a, b in spans for p in range(a, b)}
        assert all(b[0] - a[0] == x.HALF and a[1] - a[0] == x.SEGMENT for a, b in zip(spans, spans[1:], strict=False))
        assert np.allclose(got[list(of)], [single[a:b].mean() for a, b in spans], atol=1e-5)
    # a scorer sees the same segments
    scorer = x.Scorer(m)
    text = " ".join("abcdefgh"[i % 8] for i in range(41))
    assert np.isclose(scorer(text), 1 / (1 + np.exp(-np.arcsinh(got[bags.doc_first[-2]:].max()))), atol=1e-5)


def test_long_clean_texts():
    rows, _ = made(1500, 5)
    scorer = x.Scorer(x.fit(iter(rows[:1000])))
    clean = [t for t, label in rows[1000:] if not label and len(x.words(t)) > 200]
    assert len(clean) > 100 and np.mean([scorer(t) >= x.THRESHOLD for t in clean]) < 0.1


def test_scale_takes_up_that_the_highest_of_many_is_high_by_chance():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 400, 6000)
    y = (rng.random(6000) < 0.2).astype(int)
    top = np.array([rng.normal(size=k).max() for k in n])
    top = np.where(y == 1, np.maximum(top, 4 + rng.normal(size=6000)), top)
    f = x._features(top, n)
    w = x._fit_scale(f, y)
    wrong = 1 / (1 + np.exp(-(f @ np.array(w)))) >= x.THRESHOLD
    assert w[0] > 0 > w[2]
    short, long = wrong[(y == 0) & (n < 100)].mean(), wrong[(y == 0) & (n >= 300)].mean()
    assert long < 1.5 * short + 0.02
