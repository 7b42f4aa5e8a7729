"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` adds the token ids of each whole text, ``decode`` turns ids back
into raw bytes.  The rank file is opened where the task runs; its path is a
parameter and must exist on every executor.

Long texts are cut before encoding at boundaries that cannot change a match
of the pre-split pattern: before a space that stands between two ASCII
letters or digits.  No match of the pattern spans such a place (words,
numbers and contractions end at a space, and a word takes the space before
it), so the parts encode to the same ids as the whole.

Defined cases: null text -> null ids and null bytes in the operators (the query reads it as
empty); empty text -> no ids, empty bytes; an unknown id in ``decode`` raises.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import get_ready, map_text

PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_ENCODERS: dict = {}


def encoder(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; built once per Python worker."""
    import tiktoken
    key = (rank_file, pattern)
    if key not in _ENCODERS:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in order, cut at the first safe boundary after each ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _ids(enc, text: str, part_chars: int) -> list[int]:
    if len(text) <= part_chars:
        return enc.encode_ordinary(text)
    return [i for p in parts(text, part_chars) for i in enc.encode_ordinary(p)]


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text",
           part_chars: int = PART_CHARS) -> DataFrame:
    """``row`` (the input row) and ``ids`` (array of int)."""
    def run(batches):
        enc = encoder(rank_file, pattern)
        for texts in batches:
            yield [[None if t is None else _ids(enc, t, part_chars) for t in texts]]

    return map_text(df, text_col, [T.StructField("ids", T.ArrayType(T.IntegerType(), False))], run)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The input columns and ``to``: the bytes that the ids stand for."""
    get_ready(df.sparkSession)
    if to in df.columns:
        raise ValueError(f"column {to} exists")
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            out = pa.array([None if i is None else enc.decode_bytes(i) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text",
               part_chars: int = PART_CHARS) -> DataFrame:
    """``row``, ``ids`` and ``decoded`` as by ``encode`` and then ``decode``, in one pass: a task needs one Python worker,
    and ids don't go back to it."""
    def run(batches):
        enc = encoder(rank_file, pattern)
        for texts in batches:
            ids = [None if t is None else _ids(enc, t, part_chars) for t in texts]
            yield [ids, [None if i is None else enc.decode_bytes(i) for i in ids]]

    return map_text(df, text_col, [T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                                   T.StructField("decoded", T.BinaryType())], run)


def ids_text(ids: Column | str) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", F.col(ids).cast("array<string>") if isinstance(ids, str) else ids.cast("array<string>"))
