"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each result as Parquet in the shared folder and reads it again as the
next stage's docs.  The first four stages return the columns of documents,
whatever these are; rows that a stage keeps are passed on whole.

1. toxicity: rows that score 0.3 or more go.
2. near duplicates: one row of each class of linked texts stays.
3. benchmark decontamination: rows with any benchmark window go.
4. secrets: every span found is replaced by a mark; no row goes.
5. byte-level BPE: token ids of every text, decoded again as a check.

Null and empty texts pass all stages (they score 0, link to nothing and hold
no windows or secrets) and end with no tokens.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rollcall.llm import bpe, decontamination, ngram_join, secret_scan, toxicity  # noqa: E402
from rollcall.llm.common import Stored, get_ready  # noqa: E402
from rollcall.session import read_table  # noqa: E402

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_rows(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    import public_tokenizers
    where = {"rank_file": public_tokenizers.path(RANK_FILE), "pattern": public_tokenizers.PATTERN}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return bpe.round_trip(texts, **where).select(
        F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_level_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stored = Stored(get_ready(spark), "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored.put(stage(spark, docs, sf_dir), name)
    return docs


# A model trained on the labels decides the first stage, which SQL can't express.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
