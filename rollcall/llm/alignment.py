"""Alignment of two tokenizers over a corpus, and how often each pair of tokens meets.

Byte offsets where tokens of both sides end cut a text into groups.  Tokens
of one group are linked pair by pair, and a pair of ids counts the documents
that hold it linked.  Each document then learns the sum of the counts of its
links and how many links lead to the best partner of their A id.

External spill counting:

1. *Spill.*  Tasks align their documents and sort the records (pair,
   document, times) of about ``RUN_LINKS`` links at a time.  The run is split
   by the radix of the pair's hash; each part lists its distinct pairs in
   side-major order (A id, then B id) with the number of documents behind each, and
   the documents in pair order, as two zstd blocks.  What is counted further
   on is one number for each pair and run, so a pair that every document
   holds is no larger than another.
2. *Count.*  One task per radix reads the pair blocks of the runs one after
   the other and merges them ``WAYS`` at a time, block-wise by a heap of
   the least last keys.  It keeps the distinct pairs of its radix, which the two
   vocabularies bound, never the runs.  Side-major order gives the maximum of
   each A id by one pass; maxima of all radixes meet in one table of at
   most one row per A id.
3. *Back.*  The runs pass the counted pairs a second time and each
   gets the counts of its own pairs, in its own order.
4. *Sum.*  A run's documents, its document lists and the counts meet by run,
   and each document's sums are built there.  All groups are of bounded size.

Stages are stored tables, so a lost executor costs running tasks only.

Tokens are found stretch by stretch: a single space or line break between
two other characters begins a new token on both sides, so texts are cut
there, and what the tokenizers say of a recent stretch is kept in the worker.
A stretch whose bytes don't come back on both sides sends the text through
whole, which decides.

Defined cases: null text, empty text and texts whose bytes don't come back
have no tokens, zeros and ''; repeated rows are documents of their own;
an empty table gives no rows.  Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import Recent, Stored, get_ready

RUN_LINKS = 4_000_000       # links sorted together
RUN_DOCS = 60_000           # and documents, so that numbers of documents fit in 16 bits
WAYS = 64                   # runs that one merge reads
BLOCK = 4096                # records that a merge takes in at once
RADIX_CHARS = 16 << 20      # characters of input for one radix
MAX_RADIX = 4096
KEPT_CHARS = 48
B_BITS = 15                 # a pair is A id << 15 | B id

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_GAPS = re.compile(r"\s\s")
_SPILL = ("run string, radix int, pairs binary, holders binary, doc_id bigint, place int, n_a bigint, n_b bigint, "
          "n_groups bigint, n_links bigint, groups_sha256 string")
_PAIRS: dict = {}


class Pair:
    """Two tokenizers and the bytes of their ids; built once per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        letters = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            if all(c in letters for c in entry):
                self.a_bytes[i] = bytes(letters[c] for c in entry)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id("▁")
        if len(self.b_bytes) > 1 << B_BITS:
            raise ValueError("too many pieces")
        self.kept = Recent()

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def align(self, stretches: list[str]) -> list[tuple | None]:
        """For each stretch, which begins with a space or line break: its groups as text, links as bytes of pairs with one
        entry per link, and tokens of A, tokens of B, groups; None if its bytes don't come back."""
        a_ids = [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        b_ids = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        return [self._links(s, a, b) for s, a, b in zip(stretches, a_ids, b_ids, strict=True)]

    def _links(self, s: str, a: list[int], b: list[int]) -> tuple | None:
        if s[0] != " " and b[:1] == [self.space]:
            b = b[1:]
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        whole = s.encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return None
        groups, links, weights = [], [], None
        i = j = at_a = at_b = first_a = first_b = 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(a_bytes[i])
                i += 1
            else:
                at_b += len(b_bytes[j])
                j += 1
            if at_a == at_b:
                left, right = a[first_a:i], b[first_b:j]
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                if len(left) * len(right) <= 256:
                    links += [x << B_BITS | y for x in left for y in right]
                else:                   # a long stretch without common ends: distinct pairs with their times
                    weights = weights or []
                    weights.append(_outer(left, right))
                first_a, first_b = i, j
        return ";".join(groups), np.array(links, "<u4").tobytes(), len(a), len(b), len(groups), weights

    def documents(self, texts: list[str | None]) -> Iterator[tuple | None]:
        """For each text what ``align`` gives for its whole, None for texts without tokens."""
        split = [_stretches(t) if t else [] for t in texts]
        found, new = self.kept.split(set().union(*split))
        fresh = {}
        for at in range(0, len(new), 5000):
            part = new[at:at + 5000]
            fresh.update(zip(part, self.align(part), strict=True))
        self.kept.add((w, v) for w, v in fresh.items() if v is not None and len(w) <= KEPT_CHARS)
        found.update(fresh)
        for text, words in zip(texts, split, strict=True):
            if not text:
                yield None
                continue
            values = list(map(found.__getitem__, words))
            if None in values:
                yield self.align([" " + text])[0]
                continue
            groups, links, n_a, n_b, n_groups, weights = zip(*values, strict=True)
            more = [w for ws in weights if ws for w in ws]
            yield ";".join(groups), b"".join(links), sum(n_a), sum(n_b), sum(n_groups), more or None


def _outer(left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray]:
    (a, n), (b, m) = np.unique(left, return_counts=True), np.unique(right, return_counts=True)
    return ((a[:, None] << B_BITS) | b[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()


def _stretches(text: str) -> list[str]:
    text = " " + text
    if _GAPS.search(text):
        return _CUT.split(text)
    words = text.replace("\n", " \n").split(" ")
    return [w if w[:1] == "\n" else " " + w for w in words[1:]]


def pair_of(a_path: str, b_path: str) -> Pair:
    key = (a_path, b_path)
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


def radix_of(pairs: np.ndarray, radixes: int) -> np.ndarray:
    """High bits of a multiplicative hash; ``radixes`` is a power of two."""
    shift = np.uint64(64 - (radixes.bit_length() - 1))
    if radixes == 1:
        return np.zeros(len(pairs), np.uint16)
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.uint16)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers, each with its type and length, as one zstd frame."""
    import zstandard
    out = []
    for x in arrays:
        kind = next(k for k, t in enumerate((np.uint8, np.uint16, np.uint32, np.uint64)) if not len(x) or x.max() <= np.iinfo(t).max)
        data = x.astype((np.uint8, np.uint16, np.uint32, np.uint64)[kind])
        out += [bytes([kind]), len(x).to_bytes(8, "little"), data.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unsqueeze(blob: bytes) -> list[np.ndarray]:
    import zstandard
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        t = np.dtype((np.uint8, np.uint16, np.uint32, np.uint64)[data[at]])
        n = int.from_bytes(data[at + 1:at + 9], "little")
        out.append(np.frombuffer(data, t, n, at + 9).astype(np.int64))
        at += 9 + n * t.itemsize
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def runs(keys: list[np.ndarray], weighted: list[tuple[np.ndarray, np.ndarray]], radixes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The parts of one run by radix.  Keys are pair << 16 | document, one per link; weighted ones come with times."""
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    new = np.flatnonzero(np.diff(key, prepend=-1))
    key, times = key[new], np.diff(new, append=len(key))
    if weighted:
        key = np.concatenate([key, *(k for k, _ in weighted)])
        times = np.concatenate([times, *(t for _, t in weighted)])
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[new], np.add.reduceat(times, new) if len(new) else times
    if not len(key):
        return
    order = np.argsort(radix_of(key >> 16, radixes), kind="stable")
    key, times = key[order], times[order]
    pair = key >> 16
    radix = radix_of(pair, radixes)
    ends = np.append(np.flatnonzero(np.diff(radix)) + 1, len(key))
    start = 0
    for end in ends.tolist():
        p = pair[start:end]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        yield (int(radix[start]), _squeeze(_steps(p[first]), np.diff(first, append=len(p))),
               _squeeze(key[start:end] & 0xFFFF, times[start:end]))
        start = end


def spill(docs: DataFrame, a_path: str, b_path: str, radixes: int, run_links: int = RUN_LINKS) -> DataFrame:
    """Rows of two kinds: documents (``radix`` null) with what they know themselves, and parts of runs."""
    names = [f.strip().split(" ")[0] for f in _SPILL.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, pair = TaskContext.get().partitionId(), pair_of(a_path, b_path)
        number, links, place = 0, 0, 0
        keys: list[np.ndarray] = []
        weighted: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            parts = list(runs(keys, weighted, radixes))
            for at in range(0, len(parts), 64):
                part = parts[at:at + 64]
                yield _batch(names, {"run": [f"{task}-{number}"] * len(part), "radix": [x[0] for x in part],
                                     "pairs": [x[1] for x in part], "holders": [x[2] for x in part]})

        for batch in batches:
            rows = {n: [] for n in ("run", "doc_id", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            for doc_id, value in zip(batch.column(0).to_pylist(), pair.documents(batch.column(1).to_pylist()), strict=True):
                if place == RUN_DOCS or links >= run_links:
                    yield from flush()
                    keys.clear()
                    weighted.clear()
                    number, links, place = number + 1, 0, 0
                groups, pairs, n_a, n_b, n_groups, more = value or ("", b"", 0, 0, 0, None)
                held = np.frombuffer(pairs, "<u4").astype(np.int64)
                n = len(held)
                keys.append(held << 16 | place)
                for p, t in more or ():
                    weighted.append((p << 16 | place, t))
                    n += int(t.sum())
                links += n
                sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                for column, x in zip(rows.values(), (f"{task}-{number}", doc_id, place, n_a, n_b, n_groups, n, sha), strict=True):
                    column.append(x)
                place += 1
            yield _batch(names, rows)
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, _SPILL)


_ARROW = {"run": pa.string(), "radix": pa.int32(), "pairs": pa.binary(), "holders": pa.binary(), "doc_id": pa.int64(),
          "place": pa.int32(), "groups_sha256": pa.string(), "counts": pa.binary(), "kind": pa.int32()}


def _batch(names: list[str], columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(c, [None] * n), _ARROW.get(c, pa.int64())) for c in names], names=names)


def merge(streams: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """K-way heap merge of sorted (pairs, counts): one sorted list, counts of equal pairs added.

    The heap has the last pair of the next block of every stream; what lies up to the least of
    these is complete in all streams and is added up at once.
    """
    at = [0] * len(streams)
    heap = [(int(p[min(block, len(p)) - 1]), k) for k, (p, _) in enumerate(streams) if len(p)]
    heapq.heapify(heap)
    pairs, counts = [], []
    while heap:
        last = heap[0][0]
        taken_p, taken_c = [], []
        for k, (p, c) in enumerate(streams):
            end = at[k] + int(np.searchsorted(p[at[k]:at[k] + block], last, "right"))
            if end > at[k]:
                taken_p.append(p[at[k]:end])
                taken_c.append(c[at[k]:end])
                at[k] = end
        while heap and heap[0][0] <= last:
            _, k = heapq.heappop(heap)
            p = streams[k][0]
            if at[k] < len(p):
                heapq.heappush(heap, (int(p[min(at[k] + block, len(p)) - 1]), k))
        p, c = np.concatenate(taken_p), np.concatenate(taken_c)
        order = np.argsort(p, kind="stable")
        p, c = p[order], c[order]
        new = np.flatnonzero(np.diff(p, prepend=-1))
        pairs.append(p[new])
        counts.append(np.add.reduceat(c, new))
    empty = np.empty(0, np.int64)
    return (np.concatenate(pairs), np.concatenate(counts)) if pairs else (empty, empty)


def _pairs_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unsqueeze(blob)
    return np.cumsum(steps), counts


def count(parts: DataFrame, radixes: int, ways: int = WAYS) -> DataFrame:
    """For every part of a run the corpus counts of its pairs (``counts``, in its order), and rows without a run that
    hold the A ids of a radix (``pairs``) and their highest counts."""
    names = ["run", "radix", "pairs", "counts"]
    twice = parts.select("run", "radix", "pairs", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
    dealt = twice.repartition(radixes, "radix").sortWithinPartitions("radix", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radix, counting = None, True
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        total = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            out = {n: [] for n in names}
            for r, k, blob, name in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                          for c in ("radix", "kind", "pairs", "run")), strict=True):
                if r != radix:
                    radix, counting, waiting = r, True, []
                    total = (np.empty(0, np.int64), np.empty(0, np.int64))
                if k == 0:
                    waiting.append(_pairs_of(blob))
                    if len(waiting) == ways:
                        total, waiting = merge([total, *waiting]), []
                    continue
                if counting:
                    total, counting, waiting = merge([total, *waiting]), False, []
                    a = total[0] >> B_BITS
                    new = np.flatnonzero(np.diff(a, prepend=-1))
                    for c, x in zip(names, (None, r, _squeeze(a[new]), _squeeze(np.maximum.reduceat(total[1], new))), strict=True):
                        out[c].append(x)
                p = _pairs_of(blob)[0]
                for c, x in zip(names, (name, r, None, _squeeze(total[1][np.searchsorted(total[0], p)])), strict=True):
                    out[c].append(x)
            if out["radix"]:
                yield _batch(names, out)

    return dealt.mapInArrow(run, "run string, radix int, pairs binary, counts binary")


def best_counts(counted: DataFrame, size: int) -> np.ndarray:
    """Highest count of each A id; one number per entry of the vocabulary, whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unsqueeze(pairs)[0]), pa.array(_unsqueeze(counts)[0])], names=["a", "n"])

    rows = counted.filter("run IS NULL").select("pairs", "counts").mapInArrow(run, "a bigint, n bigint")
    best = np.zeros(size, np.int64)
    for a, n in rows.groupBy("a").agg(F.max("n").alias("n")).collect():
        best[a] = n
    return best


def _sum(spilled: DataFrame, counted: DataFrame, best: np.ndarray) -> DataFrame:
    """Documents with the sums over their links."""
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    null = F.lit(None)
    both = spilled.select("run", "radix", F.when(F.col("radix").isNull(), 2).otherwise(1).alias("kind"), "place", "pairs", "holders", *keep,
                          null.cast("binary").alias("counts")).unionByName(
        counted.filter("run IS NOT NULL").select("run", "radix", F.lit(0).alias("kind"), "counts"), allowMissingColumns=True)
    # per radix the counts come first, then the part of the run; a run's documents come last
    dealt = both.repartition("run").sortWithinPartitions("run", F.coalesce("radix", F.lit(1 << 30)), "kind", "place")
    best = best.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, counts = None, None
        total, hits = np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("run", "kind", "place", "counts", "pairs", "holders")}
            kinds, places = col["kind"].to_pylist(), col["place"].to_pylist()
            rows, sums, bests = [], [], []
            for i, r in enumerate(col["run"].to_pylist()):
                if r != name:
                    name = r
                    total[:], hits[:] = 0, 0
                if kinds[i] == 0:
                    counts = _unsqueeze(col["counts"][i].as_py())[0]
                elif kinds[i] == 1:
                    pairs, docs = _pairs_of(col["pairs"][i].as_py())
                    place, times = _unsqueeze(col["holders"][i].as_py())
                    np.add.at(total, place, np.repeat(counts, docs) * times)
                    np.add.at(hits, place, np.repeat(counts == best[pairs >> B_BITS], docs) * times)
                else:
                    rows.append(i)
                    sums.append(int(total[places[i]]))
                    bests.append(int(hits[places[i]]))
            if rows:
                taken = pa.Table.from_batches([batch]).select(keep).take(rows)
                yield from taken.append_column("n_best", pa.array(bests, pa.int64())).append_column(
                    "count_sum", pa.array(sums, pa.int64())).combine_chunks().to_batches()

    return dealt.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                                 "n_best bigint, count_sum bigint")


def align(docs: DataFrame, a_path: str, b_path: str, run_links: int = RUN_LINKS, radixes: int | None = None) -> DataFrame:
    """Per document (columns ``doc_id`` and ``text``): tokens, groups, links, links to the best partner, sum of counts."""
    spark = get_ready(docs.sparkSession)
    stored = Stored(spark, "alignment")
    if radixes is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        radixes = min(MAX_RADIX, max(16, 1 << (int(chars) // RADIX_CHARS).bit_length()))
    spilled = stored.put(spill(docs, a_path, b_path, radixes, run_links), "spill")
    counted = stored.put(count(spilled.filter("radix IS NOT NULL"), radixes), "counts")
    from tokenizers import Tokenizer
    size = max(Tokenizer.from_file(a_path).get_vocab().values()) + 1
    return _sum(spilled, counted, best_counts(counted, size))
