"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams (with word
ends) and of itself, so a misspelling that was never seen shares most of its
vectors with the word it stands for.  A segment of consecutive words is the
mean of its words; a linear softmax over the two classes judges it.  Vectors
and softmax are trained jointly in numpy.

A label holds for a whole document, while a few words decide it: a document is
as toxic as its most toxic segment.  Training therefore takes from a toxic
document the segment that the model of the epoch before finds most toxic (all
segments in the first epoch), and from a clean one that segment and a random
one.  Segments overlap by half, so a short passage lies whole in one of them.  A
last step fits the probability of a document to its highest segment and to the
number of its segments, since the highest of many is high by chance.

Training reads a bounded sample of the labelled rows (``TRAIN_ROWS`` rows and
``TRAIN_CHARS`` characters, in the order of a hash of the id) in one task;
scoring reads every whole text.

Defined cases: a text without letters (null, empty, digits) scores 0; labels
that are null are not learned from, several labels of one id count as their
largest; without labels of both classes every text scores the share of toxic
labels (0 without labels); equal texts score alike.  For texts far longer than
all labelled ones the fit on the number of segments is an extrapolation.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import Stored, fold, get_ready, map_text

TRAIN_ROWS = 24_000
TRAIN_CHARS = 128_000_000
SEGMENT, HALF = 16, 8   # words; a segment begins at every half
GRAMS = (3, 4, 5)       # characters
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 4
SCALE_EVERY, CROSS_ROWS, CROSS_FOLDS = 7, 2000, 4
BATCH = 32
RATE = 0.5
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
KEPT_WORDS = 1 << 18

_RUN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits that are not digits alone: a digit may stand for a letter."""
    return [w for w in _RUN.findall(text.lower()) if not w.isdecimal()] if text else []


def subwords(word: str) -> list[int]:
    """Bucket numbers of the word and its character n-grams."""
    s = f"<{word}>"
    out = [xxhash.xxh32_intdigest(s) % BUCKETS]
    for n in GRAMS:
        out += [xxhash.xxh32_intdigest(s[i:i + n], n) % BUCKETS for i in range(len(s) - n + 1)]
    return out


@dataclass
class Model:
    vectors: np.ndarray         # BUCKETS x DIM
    softmax: np.ndarray         # DIM x 2
    bias: np.ndarray            # 2
    scale: tuple[float, ...]    # weights of _features, whose sum is the logit of a document
    constant: float | None = None

    def to_bytes(self) -> bytes:
        import io
        f = io.BytesIO()
        np.savez(f, vectors=self.vectors, softmax=self.softmax, bias=self.bias, scale=np.array(self.scale),
                 constant=np.array([] if self.constant is None else [self.constant]))
        return f.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        import io
        z = np.load(io.BytesIO(data))
        constant = float(z["constant"][0]) if len(z["constant"]) else None
        return Model(z["vectors"], z["softmax"], z["bias"], tuple(map(float, z["scale"])), constant)


class Bags:
    """Documents as word numbers cut into segments; words as subword numbers.  All in flat arrays of 4-byte numbers."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.subs, self.sub_counts = array("i"), array("i")
        self.words, self.word_counts = array("i"), array("i")
        self.labels: list[int] = []

    def add(self, text: str, label: int) -> None:
        found = words(text)
        for w in found:
            k = self.numbers.get(w)
            if k is None:
                k = self.numbers[w] = len(self.numbers)
                subs = subwords(w)
                self.subs.extend(subs)
                self.sub_counts.append(len(subs))
            self.words.append(k)
        if found:
            self.word_counts.append(len(found))
            self.labels.append(label)

    def close(self) -> None:
        self.numbers = {}
        self.sub_flat = np.frombuffer(self.subs, np.int32)
        self.sub_len = np.array(self.sub_counts, np.int64)
        self.sub_off = np.concatenate(([0], np.cumsum(self.sub_len)))[:-1]
        self.word_flat = np.frombuffer(self.words, np.int32)
        length = np.array(self.word_counts, np.int64)
        halves = -(-length // HALF)
        self.seg_count = np.maximum(1, halves - 1)
        self.doc_first = np.concatenate(([0], np.cumsum(self.seg_count)))
        start = np.concatenate(([0], np.cumsum(length)))[:-1]
        self.half_start = np.repeat(start, halves) + HALF * _spread(np.zeros(len(length), np.int64), halves)
        half_first = np.concatenate(([0], np.cumsum(halves)))[:-1]
        self.seg_doc = np.repeat(np.arange(len(length)), self.seg_count)
        self.seg_at = _spread(np.zeros(len(length), np.int64), self.seg_count)     # number within the document
        self.seg_half = half_first[self.seg_doc] + self.seg_at
        self.seg_start = start[self.seg_doc] + self.seg_at * HALF
        self.seg_len = np.minimum(SEGMENT, start[self.seg_doc] + length[self.seg_doc] - self.seg_start)
        self.y = np.array(self.labels, np.int64)

    def word_scores(self, m: Model) -> np.ndarray:
        v = m.vectors @ (m.softmax[:, 1] - m.softmax[:, 0])
        return np.add.reduceat(v[self.sub_flat], self.sub_off) / self.sub_len

    def segment_scores(self, m: Model) -> np.ndarray:
        halves = np.add.reduceat(self.word_scores(m)[self.word_flat], self.half_start)
        sums = halves[self.seg_half]
        two = self.seg_len > HALF
        sums[two] += halves[self.seg_half[two] + 1]
        return sums / self.seg_len + (m.bias[1] - m.bias[0])

    def top_segments(self, scores: np.ndarray) -> np.ndarray:
        """The segment of each document with the highest score."""
        order = np.lexsort((-scores, self.seg_doc))
        return order[self.doc_first[:-1]]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all stretches one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _step(m: Model, grown: np.ndarray, bags: Bags, segs: np.ndarray, y: np.ndarray) -> None:
    """One joint update of vectors and softmax on a batch of segments."""
    n_words = bags.seg_len[segs]
    word = bags.word_flat[_spread(bags.seg_start[segs], n_words)]
    n_subs = bags.sub_len[word]
    sub = bags.sub_flat[_spread(bags.sub_off[word], n_subs)]
    weight = np.repeat(1 / (n_subs * np.repeat(n_words, n_words)), n_subs).astype(np.float32)
    of = np.repeat(np.repeat(np.arange(len(segs)), n_words), n_subs)
    starts = np.searchsorted(of, np.arange(len(segs)))
    hidden = np.add.reduceat(m.vectors[sub] * weight[:, None], starts, axis=0)
    z = hidden @ m.softmax + m.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    back = (p @ m.softmax.T).astype(np.float32)
    m.softmax -= RATE * (hidden.T @ p) * (64 / len(y))
    m.bias -= 0.1 * RATE * p.mean(axis=0)
    rows, place = np.unique(sub, return_inverse=True)
    g = back[of] * weight[:, None]
    total = np.stack([np.bincount(place, g[:, k], len(rows)) for k in range(DIM)], axis=1).astype(np.float32)
    grown[rows] += (total ** 2).mean(axis=1)
    m.vectors[rows] -= 0.1 * RATE * total / np.sqrt(grown[rows])[:, None]


def _features(top: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """What the logit of a document is made of: its highest segment, one, its number of segments."""
    return np.stack([np.arcsinh(top), np.ones(len(top)), np.log(segments)], axis=1)


def _fit_scale(f: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic fit of y on features, slightly shrunk, by Newton steps that never raise the loss."""
    shrink = np.array([1e-1, 1e-6, 1e-1])

    def loss(w: np.ndarray) -> float:
        z = f @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (shrink * w * w).sum() / 2)

    w = np.array([0.0, np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)), 0.0])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        move = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.diag(shrink), f.T @ (y - p) - shrink * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * move) > now:
            size /= 2
        if size <= 1e-6 or now - loss(w + size * move) < 1e-10:
            break
        w = w + size * move
        now = loss(w)
    return tuple(map(float, w))


def fit(rows: Iterator[tuple[str, int]], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Train on (text, label) rows until they end or ``TRAIN_CHARS`` characters are read."""
    bags, chars, seen = Bags(), 0, [0, 0]
    for text, label in rows:
        bags.add(text, label)
        seen[label] += 1
        chars += len(text)
        if chars >= TRAIN_CHARS:
            break
    m = _start(seed)
    if len(set(bags.labels)) < 2:
        m.constant = seen[1] / max(1, sum(seen))
        return m
    bags.close()
    n = len(bags.y)
    fold_of = np.random.default_rng(seed).permutation(n) % (CROSS_FOLDS if n < CROSS_ROWS else SCALE_EVERY)
    judged = np.full(n, np.nan)
    for fold_ in range(CROSS_FOLDS) if n < CROSS_ROWS else (SCALE_EVERY - 1,):
        m = _start(seed)
        _train(m, bags, fold_of != fold_, epochs, seed)
        scores = bags.segment_scores(m)
        top = scores[bags.top_segments(scores)]
        judged[fold_of == fold_] = top[fold_of == fold_]
    if n < CROSS_ROWS:
        m = _start(seed)
        _train(m, bags, np.ones(n, bool), epochs, seed)
    known = ~np.isnan(judged)
    m.scale = _fit_scale(_features(judged[known], bags.seg_count[known]), bags.y[known])
    return m


def _start(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    return Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32),
                 rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32), (1.0, 0.0, 0.0))


def _train(m: Model, bags: Bags, use: np.ndarray, epochs: int, seed: int) -> None:
    """Train on the documents that ``use`` marks."""
    rng = np.random.default_rng(seed)
    grown = np.full(BUCKETS, 1e-6, np.float32)
    toxic, clean = np.flatnonzero((bags.y == 1) & use), np.flatnonzero((bags.y == 0) & use)
    odds = 0.0
    for epoch in range(epochs):
        some = bags.doc_first[:-1][clean] + rng.integers(0, np.diff(bags.doc_first)[clean])
        if epoch:
            top = bags.top_segments(bags.segment_scores(m))
            up, down = top[toxic], np.union1d(some, top[clean])
        else:
            up, down = np.flatnonzero(((bags.y == 1) & use)[bags.seg_doc] & (bags.seg_at % 2 == 0)), some
        # the share of toxic segments differs between epochs; the bias takes that up at once, so no word has to
        odds, before = np.log(max(1, len(up)) / max(1, len(down))), odds
        m.bias += np.array([-0.5, 0.5], np.float32) * np.float32(odds - before)
        segs = np.concatenate((up, down))
        y = np.concatenate((np.ones(len(up), np.int64), np.zeros(len(down), np.int64)))
        order = rng.permutation(len(segs))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            _step(m, grown, bags, segs[part], y[part])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", label_id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fit a model on the labelled rows of ``docs`` outside the held-out fold."""
    spark = get_ready(docs.sparkSession)
    stored = Stored(spark, "toxicity")
    learn = (labels.select(F.col(label_id_col).alias("id"), (F.col(label_col) >= 1).cast("int").alias("label"))
             .filter("id is not null and label is not null").filter(fold("id", FOLDS) != HELD_OUT)
             .groupBy("id").agg(F.max("label").alias("label")))
    learn = stored.put(learn.orderBy(F.xxhash64("id"), "id").limit(rows), "sample")
    texts = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
             .filter("text is not null")
             .join(F.broadcast(learn), F.col("doc_id") == F.col("id")))       # at most ``rows`` small rows
    texts = (texts.select("text", "label", F.xxhash64("id", "text").alias("at")).orderBy("at", "text", "label")
             .limit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([fit(pairs()).to_bytes()], pa.binary())], names=["model"])

    fitted = texts.select("text", "label").coalesce(1).mapInArrow(run, "model binary")
    found = stored.put(fitted, "model").first()
    return Model.from_bytes(bytes(found["model"])) if found else fit(iter(()))      # no rows: no task


class Scorer:
    """Scores texts; keeps the scores of a bounded number of words."""

    def __init__(self, m: Model):
        self.constant, self.scale = m.constant, m.scale
        self.bias = float(m.bias[1] - m.bias[0])
        self.v = (m.vectors @ (m.softmax[:, 1] - m.softmax[:, 0])).astype(np.float64)
        scorer = self

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= KEPT_WORDS:
                    self.clear()
                s = self[word] = float(scorer.v[subwords(word)].mean())
                return s
        self.known = Known()

    def __call__(self, text: str | None) -> float:
        found = words(text)
        if self.constant is not None:
            return self.constant
        if not found:
            return 0.0
        s = np.fromiter(map(self.known.__getitem__, found), np.float64, len(found))
        starts = np.arange(0, len(s), HALF)
        sums = np.add.reduceat(s, starts)
        if len(starts) > 1:
            starts, sums = starts[:-1], sums[:-1] + sums[1:]
        means = sums / np.minimum(SEGMENT, len(s) - starts)
        a, b, c = self.scale
        z = a * np.arcsinh(means.max() + self.bias) + b + c * np.log(len(means))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (the input row) and ``score`` (0 to 1)."""
    sent = get_ready(docs.sparkSession).sparkContext.broadcast(model.to_bytes())   # BUCKETS x DIM floats

    def run(batches):
        scorer = Scorer(Model.from_bytes(sent.value))
        for texts in batches:
            yield [[scorer(t) for t in texts]]

    return map_text(docs, text_col, [T.StructField("score", T.DoubleType())], run)


def clean_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **names) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with their columns."""
    model = train(docs, labels, **names)
    scored = score(docs, model, names.get("text_col", "text"))
    return scored.filter(F.col("score") < threshold).select("row.*")
