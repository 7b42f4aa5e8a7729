"""Substring search over a stored table by a trigram index (Q1).

Rows are stored in groups of consecutive rows in a given order; a posting
table says which groups hold a trigram of the searchable text.  A search
takes the groups that hold every trigram of its term, reads only these and
applies the exact predicate, so its rows are those of a scan.  How many
groups are left depends on the order: terms whose rows lie together (an
e-mail, a workshop) need few, a term that is everywhere needs all.

Terms of fewer than three characters, and empty ones, read all groups.  Null
cells count as empty texts.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.ordering import with_position
from rollcall.operators.search import search_predicate, searchable_text
from rollcall.sinks.writers import read_small, write_small

GROUP_ROWS = 100_000
BUCKETS = 64
SIZE = 3


def write(df: DataFrame, path: str, columns: list[str], order: list[str], group_rows: int = GROUP_ROWS,
          buckets: int = BUCKETS) -> None:
    """Store ``df`` with an index over ``columns``; ``order`` decides which rows lie together.  The description is
    written last, so a table whose writing broke off can't be searched."""
    spark, base = df.sparkSession, path.rstrip("/")
    placed = with_position(df, [F.col(c) for c in order], "__at", start=0) \
        .withColumn("__group", F.floor(F.col("__at") / group_rows))
    (placed.repartitionByRange("__group", "__at").sortWithinPartitions("__group", "__at").drop("__at")
     .write.partitionBy("__group").parquet(f"{base}/rows"))
    stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__group", T.LongType())])).parquet(f"{base}/rows")
    # a look-ahead finds the trigram at every place in one pass over the text
    grams = F.regexp_extract_all(searchable_text(columns), F.lit(f"(?s)(?=({'.' * SIZE}))"), F.lit(1))
    postings = stored.select("__group", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
    (postings.withColumn("bucket", F.crc32(F.col("gram").cast("binary")) % buckets)
     .repartition("bucket", "gram").write.partitionBy("bucket").parquet(f"{base}/postings"))
    write_small(spark, f"{base}/index.json", json.dumps({"columns": columns, "buckets": buckets, "schema": df.schema.jsonValue()}))


def candidate_groups(spark: SparkSession, path: str, term: str) -> list[int] | None:
    """Groups that hold every trigram of the (lower-cased) term; None if it has none, so that all groups are candidates."""
    about = json.loads(read_small(spark, f"{path.rstrip('/')}/index.json"))
    grams = sorted({term[i:i + SIZE] for i in range(len(term) - SIZE + 1)})
    if not grams:
        return None
    buckets = sorted({zlib.crc32(g.encode()) % about["buckets"] for g in grams})
    schema = "__group long, gram string, bucket long"
    postings = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/postings")
    hits = postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    # one number per group of rows
    return sorted(r["__group"] for r in hits.groupBy("__group").count().filter(F.col("count") == len(grams)).collect())


def search(spark: SparkSession, path: str, term: str | None, trim: bool = True) -> DataFrame:
    """Q1 over the stored table: the rows that ``operators.search.search`` finds."""
    base = path.rstrip("/")
    about = json.loads(read_small(spark, f"{base}/index.json"))
    schema = T.StructType.fromJson(about["schema"])
    plain = (term or "").lower()
    groups = candidate_groups(spark, base, plain.strip() if trim else plain)
    if groups is not None and not groups:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema)
    rows = rows.option("recursiveFileLookup", "true").parquet(f"{base}/rows") if groups is None \
        else rows.parquet(*[f"{base}/rows/__group={g}" for g in groups])
    return rows.filter(search_predicate(about["columns"], term, trim))
