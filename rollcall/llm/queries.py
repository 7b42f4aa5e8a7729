"""Registered queries of the operators in this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import (
    alignment, bpe, conversation_repair, decontamination, html_extract, lm_score, ngram_join, packing, secret_scan, token_counts, toxicity, vector_search, warc_audit)
from rollcall.llm.common import Stored, documents_of, fold, get_ready
from rollcall.session import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(read_table(spark, sf_dir, "documents"))


def _ranks() -> dict[str, str]:
    import public_tokenizers
    return {"rank_file": public_tokenizers.path(RANK_FILE), "pattern": public_tokenizers.PATTERN}


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        (fold(F.col("row.doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


_OP2_SQL = """
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM words, sizes, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size),
found AS (SELECT r, size, i, item_id FROM spots JOIN windows USING (size, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS v(p) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query("op2_benchmark_decontamination", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole document."""
    found = decontamination.find(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", decontamination.hit_words("spans").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits that its own text gives: a
    stretch in the middle is cut out, the beginning is repeated behind it, the end is replaced."""
    docs = _documents(spark, sf_dir).withColumn("n", F.length("text").cast("bigint"))
    third = F.floor(F.col("n") / 3)
    cut = F.least(F.lit(40), F.floor(F.col("n") / 5))
    edits = F.array(
        F.struct(third.alias("start"), (third + cut).alias("end"), F.lit("").alias("text")),
        F.struct((third + cut).alias("start"), (third + cut).alias("end"), F.substring("text", 1, 30).alias("text")),
        F.struct((F.col("n") - cut).alias("start"), (F.col("n") + 100).alias("end"), F.lit(" fin.\n").alias("text")))
    counted = token_counts.recount(docs.withColumn("edits", edits), **_ranks())
    return counted.select(F.col("row.doc_id").alias("doc_id"), "n_before", "n_after", "n_pieces", "n_encoded",
                          "n_skipped", F.sha2("edited", 256).alias("edited_sha256"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the bytes they decode to."""
    where = _ranks()
    coded = bpe.encode(_documents(spark, sf_dir), **where).select(F.col("row.doc_id").alias("doc_id"), "ids")
    return bpe.decode(coded, **where).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    found = secret_scan.scan(_documents(spark, sf_dir))

    def of(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("found", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"),
        of("hex").alias("n_hex"), F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("found")).alias("spans"))


_OP7_SQL = """
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM words, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.r = x JOIN sizes t ON t.r = y WHERE c >= 0.8 * (s.n + t.n - c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
best AS (SELECT x, min(doc_id) AS low FROM reach JOIN words ON words.r = reach.y GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id,
       CAST((SELECT count(*) FROM links WHERE links.x = words.r) AS BIGINT) AS n_links
FROM words LEFT JOIN best ON best.x = words.r
"""


@query("op7_ngram_jaccard_join", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all documents."""
    return ngram_join.near_duplicates(_documents(spark, sf_dir))


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return vector_search.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_lm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every whole document."""
    return lm_score.score(_documents(spark, sf_dir))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.fit(pages))
    return found.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text",
                        F.length("text").cast("bigint").alias("n_chars"))


_OP3_SQL = """
WITH records AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'unknown') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
hashed AS (
  SELECT sha256(record) AS d, octet_length(encode(record)) AS n,
         CASE WHEN page_id % 89 = 7 THEN NULL
              WHEN page_id % 97 = 5 THEN sha256(left(record, length(record) - 1) || 'X') ELSE sha256(record) END AS e
  FROM records),
filed AS (
  SELECT *, CAST('0x' || left(d, 8) AS BIGINT) % (SELECT greatest(1, ceil(sum(n) / 67108864.0))::BIGINT FROM hashed) AS file
  FROM hashed),
placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM filed)
SELECT CAST(file AS BIGINT) AS file, CAST(o AS BIGINT) AS "offset", CAST(n AS BIGINT) AS length_a,
       CAST(CASE WHEN e IS NOT NULL THEN n ELSE 0 END AS BIGINT) AS length_b, d AS digest_a,
       coalesce(e, '') AS digest_b,
       CASE WHEN e IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE e IS DISTINCT FROM d
"""


@query("op3_warc_fixity_audit", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, audited against a replica in which records of page ids 5 modulo 97
    have a wrong last byte and those of page ids 7 modulo 89 are lost (length 0 and no digest there)."""
    record = F.col("record")
    hashed = warc_audit.write_records(read_table(spark, sf_dir, "pages")).select(
        warc_audit.digest(record).alias("digest"), F.octet_length(record).cast("bigint").alias("length"),
        F.when(F.col("page_id") % 89 == 7, F.lit(None))
        .when(F.col("page_id") % 97 == 5, warc_audit.digest(F.concat(F.expr("left(record, length(record) - 1)"), F.lit("X"))))
        .otherwise(warc_audit.digest(record)).alias("replica"))
    placed = Stored(get_ready(spark), "warc-replicas").put(warc_audit.lay_out(hashed), "records")
    second = placed.select("file", "offset", "length", F.col("replica").alias("digest"))
    damage = warc_audit.audit(placed.select("file", "offset", "length", "digest"), second)
    return damage.fillna(0, ["length_a", "length_b"]).fillna("", ["digest_a", "digest_b"])


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    import public_tokenizers
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, and how common they are."""
    import public_tokenizers
    return alignment.align(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    return conversation_repair.repair(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
