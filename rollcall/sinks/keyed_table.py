"""Keyed tables that are rewritten partition by partition (O5 for merges).

The rows of a table are dealt by a hash of their key into partitions, as many
as the table's size asks for when it is created; the manifest keeps their number.  A commit rewrites only the partitions that its keys touch, into a
folder of its own, and publishes a manifest that names, for every partition,
the folder that holds it; the pointer to the manifest moves with one rename.
Readers see the old or the new table, never a mixture, and untouched
partitions keep their files.

The manifest also holds the last batch applied per stream, so a replayed
batch changes nothing while a new stream, which starts at batch 0 again, is
applied in full.  ``vacuum`` removes folders that the manifest no longer
names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.sinks import writers as W

PARTITIONS = 64             # at least
PART_ROWS = 1_000_000       # rows of a partition, about
PART = "__part"


@dataclass
class Manifest:
    keys: list[str]
    partitions: int
    schema: str                                         # of the table, as JSON
    parts: dict[str, str] = field(default_factory=dict)     # partition -> folder; no entry: no rows
    applied: dict[str, int] = field(default_factory=dict)   # stream -> last batch

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def _part_of(m: Manifest) -> Column:
    """Partition of a row; keys are hashed as the table's types, whatever types a batch brings."""
    types = m.struct()
    return F.pmod(F.xxhash64(*[F.col(k).cast(types[k].dataType) for k in m.keys]), F.lit(m.partitions))


def manifest(spark: SparkSession, path: str) -> Manifest:
    name = W.current_version(spark, path)
    if name is None:
        raise FileNotFoundError(f"no published table under {path}")
    return Manifest(**json.loads(W.read_small(spark, f"{path.rstrip('/')}/{name}")))


def _publish(spark: SparkSession, path: str, m: Manifest) -> None:
    name = f"manifest-{uuid.uuid4().hex}.json"
    W.write_small(spark, f"{path.rstrip('/')}/{name}", json.dumps(m.__dict__))
    W.publish(spark, path, name)


def partitions_for(df: DataFrame) -> int:
    """Partitions of about ``PART_ROWS`` rows, so a batch of few keys rewrites a small part of a large table."""
    return max(PARTITIONS, -(-df.count() // PART_ROWS))


def create(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Write ``df`` as a new table."""
    partitions = partitions or partitions_for(df)
    m = Manifest(list(keys), partitions, df.schema.json())
    _publish(df.sparkSession, path, _written(df, path, m, f"v-{uuid.uuid4().hex}", set()))


def read(spark: SparkSession, path: str, parts: set[int] | None = None) -> DataFrame:
    """The table, or only some of its partitions."""
    m = manifest(spark, path)
    folders = [f"{path.rstrip('/')}/{v}/{PART}={p}" for p, v in sorted(m.parts.items()) if parts is None or int(p) in parts]
    if not folders:
        return spark.createDataFrame([], m.struct())
    return spark.read.schema(m.struct()).parquet(*folders)


def touched(batch: DataFrame, path: str) -> set[int]:
    """Partitions that a batch's keys fall into: at most the table's number of partitions."""
    part = _part_of(manifest(batch.sparkSession, path))
    return {r[0] for r in batch.select(part.alias("p")).distinct().collect()}


def applied(spark: SparkSession, path: str, stream: str) -> int:
    """The last batch of a stream that the table holds; -1 for none."""
    return manifest(spark, path).applied.get(stream, -1)


def commit(state: DataFrame, path: str, parts: set[int], stream: str, batch_id: int) -> None:
    """Replace the partitions ``parts`` by the rows of ``state`` and note the batch."""
    spark = state.sparkSession
    m = manifest(spark, path)
    m = _written(state, path, m, f"v-{stream}-{batch_id}", parts)
    m.applied[stream] = batch_id
    _publish(spark, path, m)


def _written(df: DataFrame, path: str, m: Manifest, version: str, replaced: set[int]) -> Manifest:
    spark, target = df.sparkSession, f"{path.rstrip('/')}/{version}"
    dealt = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in m.struct().fields], _part_of(m).alias(PART))
    # a partition is written by the tasks that hold its rows; its files are as many as its size asks for
    dealt.hint("rebalance", F.col(PART)).write.mode("overwrite").partitionBy(PART).parquet(target)
    found = {name.split("=", 1)[1] for name in W.list_names(spark, target) if name.startswith(f"{PART}=")}
    kept = {p: v for p, v in m.parts.items() if int(p) not in replaced}
    return Manifest(m.keys, m.partitions, m.schema, kept | dict.fromkeys(found, version), dict(m.applied))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete versions and manifests that the current table does not use; no reader may still hold an older one."""
    m, now = manifest(spark, path), W.current_version(spark, path)
    used = set(m.parts.values()) | {now}
    gone = [n for n in W.list_names(spark, path) if n.startswith(("v-", "manifest-")) and n not in used]
    for n in gone:
        W.delete(spark, f"{path.rstrip('/')}/{n}")
    return gone
