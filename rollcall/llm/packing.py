"""Best-fit packing of tokenised documents into sequences of bounded length.

Hierarchical residual packing.  Documents are tokenised once and cut into
pieces of at most ``size`` tokens; a full piece is a sequence of its own.  The
other pieces are dealt evenly into leaf tasks of about ``leaf`` pieces, and each
leaf packs its pieces best-fit, longest first.  Nearly full bins (at most
``slack`` tokens free) leave at once.  Underfull bins are items of the next
round, in which one task packs the rest of ``FAN`` tasks, and so on up a tree to a
single task.

What goes up is bounded by the number of leaves, not by the pieces.  After
best-fit no two bins of a task fit together, so at most one is half full or
less.  A merge needs such a small bin; the ``t`` leaves have at most ``t`` of
them together, so no more than ``t`` larger bins can ever take one in, and of two
larger bins the one with more room is at least as good.  A task therefore
sends up its small bin and the ``t`` larger ones with most room; the others leave
as they are, which changes no count.

Every round is a stored table, so a lost executor costs running tasks only.

Tokens: a document is split at single ASCII spaces and line breaks, which the
tokenizer drops and across which no token reaches; the ids of each distinct
stretch are kept in the Python worker (bounded), so frequent words are encoded
once.  Defined cases: null and empty text are one closing id; repeated rows
are packed as often as they occur; an empty table gives no pieces.  Extra
columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import Recent, Stored, get_ready

SIZE = 2048
END_ID = 0
LEAF = 16384        # pieces that one leaf task packs, about
FAN = 8             # tasks whose rest one task of the next round packs
SLACK = 8           # free tokens of a nearly full bin
KEPT_CHARS = 48     # longer stretches are encoded afresh

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PACKED = f"{_PIECE}, sequence_id bigint, offset bigint, done boolean, task int"
_WORDS: dict = {}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_ODD = re.compile(f"[^\x20-\x7e{_LATIN}]|[^A-Za-z0-9\x20{_LATIN}]{{2}}")
# Printable Latin-1 characters stand for their own byte, the others in order for U+0100 and on.
_OWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _OWN)}


class Words:
    """Ids of stretches of text between spaces, as little-endian unsigned 32-bit numbers.

    A stretch of lower-case Latin letters needs no normalising and no
    splitting, so the tokenizer's model encodes it directly; every other
    stretch takes the tokenizer's whole way.  Recent stretches are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept = Recent()

    def of(self, stretches: set[str]) -> dict[str, bytes]:
        found, new = self.kept.split(stretches)
        one, fresh, hard = self.tokenizer.model.tokenize, {}, []
        for w in new:
            if _PLAIN.fullmatch(w):
                ids = [t.id for t in one(w if w.isascii() else byte_level(w))]
                fresh[w] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
            else:
                hard.append(w)
        for at in range(0, len(hard), 10_000):
            part = hard[at:at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                fresh[w] = np.array(e.ids, "<u4").tobytes()
        self.kept.add((w, v) for w, v in fresh.items() if len(w) <= KEPT_CHARS)
        found.update(fresh)
        return found


def stretches_of(text: str) -> list[str]:
    """The text split where no token can reach across: at spaces and line breaks, and, in texts of
    plain characters without neighbouring marks, before a mark at the end of a word.  Lower case
    is applied only to such texts, whose letters each have one plain lower-case form."""
    text = text.replace("\n", " ")
    if not _ODD.search(text):
        text = text.lower() + " "
        for mark in ".,;:!?":
            text = text.replace(mark + " ", " " + mark + " ")
    return text.split(" ")


def byte_level(word: str) -> str:
    """The letters that stand for the UTF-8 bytes of the word in a byte-level vocabulary."""
    return word.encode().decode("latin-1").translate(_BYTE_LETTERS)


def words_encoder(path: str) -> Words:
    """Built once per Python worker."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def token_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text."""
    split = [stretches_of(t) for t in texts]
    ids = words_encoder(path).of(set().union(*split)).__getitem__
    for words in split:
        yield b"".join(map(ids, words))


def cut(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document (columns ``doc_id`` and ``text``): number, start, length and checksum of its ids."""
    get_ready(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc_id, coded in zip(ids, token_bytes(texts, path), strict=True):
                coded += end
                for k, at in enumerate(range(0, len(coded), 4 * size)):
                    part = memoryview(coded)[at:at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _types()[:5], strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def _types() -> list[pa.DataType]:
    return [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of items in the given order: bin and place of each item, and the fill of each bin.

    An item goes to the bin with the least room that takes it.  Bins are kept
    by their room; one big integer has a bit for each room that some bin has.
    """
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, fill = 0, []
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            room, b = size, len(fill)
            fill.append(0)
        bins[k], places[k] = b, fill[b]
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, places, np.array(fill, np.int64)


def _leaving(fill: np.ndarray, size: int, slack: int, leaves: int) -> np.ndarray:
    """Which bins leave now: nearly full ones, and larger ones beyond the ``leaves`` with most room."""
    done = fill >= size - slack
    larger = np.flatnonzero(~done & (2 * fill > size))
    if len(larger) > leaves:
        done[larger[np.argsort(fill[larger], kind="stable")[leaves:]]] = True
    return done


def _pack(df: DataFrame, level: int, leaves: int, size: int, slack: int, last: bool) -> DataFrame:
    """Pack what each partition holds.  Items are the pieces at level 0 and the bins of the level below after that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        col = {n: table.column(n).to_numpy() for n in ("length", "sequence_id", "offset")}
        if level:
            ids, item = np.unique(col["sequence_id"], return_inverse=True)
            lengths = np.bincount(item, weights=col["length"]).astype(np.int64)
        else:
            item, lengths = np.arange(table.num_rows), col["length"]
        order = np.argsort(-lengths, kind="stable")
        packed = best_fit(lengths[order], size)
        bins, places = np.empty_like(order), np.empty_like(order)
        bins[order], places[order] = packed[:2]
        done = np.full(len(packed[2]), True) if last else _leaving(packed[2], size, slack, leaves)
        # number of the level, then of the task, then of the bin: unique over all rounds
        sequence = bins[item] + ((level + 1 << 56) + (task << 32))
        out = [*(table.column(n).combine_chunks() for n in ("doc_id", "piece", "start", "length", "ids_crc32")),
               pa.array(sequence), pa.array(places[item] + (col["offset"] if level else 0)), pa.array(done[bins[item]]),
               pa.array(np.full(len(item), task, np.int32))]
        packed_table = pa.Table.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                                                        "offset", "done", "task"])
        yield from packed_table.to_batches(max_chunksize=20_000)

    return df.mapInArrow(run, _PACKED)


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, leaf: int = LEAF, fan: int = FAN,
         slack: int = SLACK) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    spark = get_ready(docs.sparkSession)
    stored = Stored(spark, "packing")
    pieces = stored.put(cut(docs, path, size, end_id), "pieces")
    short = pieces.filter(F.col("length") < size).withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn(
        "offset", F.lit(0).cast("bigint"))
    leaves = tasks = max(1, -(-short.count() // leaf))
    out = pieces.filter(F.col("length") == size).withColumn(
        "sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    level, rest = 0, short.repartition(tasks)
    while True:
        last = tasks == 1
        packed = stored.put(_pack(rest, level, leaves, size, slack, last), f"level{level}")
        out = out.unionByName(packed.filter("done").drop("done", "task"))
        if last:
            return out
        tasks, level = -(-tasks // fan), level + 1
        rest = packed.filter("NOT done").repartition(tasks, F.floor(F.col("task") / fan))
