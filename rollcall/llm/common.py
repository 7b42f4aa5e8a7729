"""Shared helpers: row-preserving Arrow maps, stored intermediate tables, folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.session import ensure_checkpoint_dir, ship_package

ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

# A-Z to a-z; every other byte that is not a-z, 0-9 or part of a non-ASCII character to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as
    UTF-8 bytes (a character outside ASCII has no byte below 128, so bytes decide alone)."""
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


def get_ready(spark: SparkSession) -> SparkSession:
    """Shared folder, package path, and Arrow batches small enough for very long texts."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def map_text(df: DataFrame, text_col: str, fields: list[T.StructField],
             fn: Callable[[Iterator[list[str | None]]], Iterator[list]], row: str = "row") -> DataFrame:
    """Run ``fn`` over the texts of ``df`` batch by batch.

    ``fn`` takes an iterator of text lists and yields, for each list, one list
    of values per field.  The result has the whole input row as struct column
    ``row`` next to the new fields, so no input column can clash with one.
    """
    get_ready(df.sparkSession)
    schema = T.StructType([T.StructField(row, df.schema, False), *fields])
    types = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str | None]]:
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    yield batch.column(0).field(text_col).to_pylist()

        for columns in fn(texts()):
            batch = held.pop(0)
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[row, *(f.name for f in fields)])
        # a worker lives on for other tasks: give back what the batches held
        pa.default_memory_pool().release_unused()

    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))
    return packed.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, a null text as the empty text."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


class Stored:
    """Intermediate tables of one query in the cluster's shared folder.

    Writing cuts lineage: a lost executor costs the tasks that were running,
    never the stages behind a stored table.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table of this query that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Recent:
    """Values of recent keys in a Python worker, in two generations of bounded size.

    When the young generation is full it becomes the old one, and the old one
    is dropped; a key that is still in use moves to the young one.
    """

    def __init__(self, size: int = 400_000):
        self.size, self.young, self.old = size, {}, {}

    def split(self, keys) -> tuple[dict, list]:
        """Values of the keys that are kept, and the other keys."""
        young, old = self.young, self.old
        found, new = {}, []
        for key in keys:
            value = young.get(key)
            if value is None:
                value = old.get(key)
                if value is None:
                    new.append(key)
                    continue
                young[key] = value
            found[key] = value
        return found, new

    def add(self, items) -> None:
        self.young.update(items)
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
