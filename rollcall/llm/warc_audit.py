"""Merkle fixity audit of WARC replicas.

A replica is a table of records with their place in an archive file (``file``,
``offset``, ``length``) and the SHA-256 of their bytes.  Records are the leaves of
one tree per file.  Its lowest nodes cover offset ranges of 2**RANGE_BITS
bytes, each level above covers 2**FAN_BITS ranges of the level below, and the
hash of a node is the SHA-256 over its children in order of offset.  The
replicas' roots are compared first; below a root that differs only branches
that differ are followed, down to the records.

Everything is joins and aggregates on (file, range).  A range holds as many
records as fit into its bytes and a node as many children as its fan, so no
group grows with the data, also where one file holds most of it.

``write_records`` makes record bytes from pages and ``lay_out`` gives them
places: files are filled by record hash up to about ``FILE_BYTES``.

Defined cases: null url or html count as empty, a null page id as
``unknown``; equal rows are records of their own at places of their own; an
empty replica has no roots, and all records of the other one are reported; a
record that both replicas hold at one place with different hashes (or
lengths) is ``changed``, one that only the first holds ``missing``, one that
only the second holds ``extra``; several different records at one place are
compared as a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import Stored, get_ready

RANGE_BITS, FAN_BITS, LEVELS = 16, 6, 6
FILE_BYTES = 1 << 26


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("unknown")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
        body, F.lit("\r\n\r\n"))


def write_records(pages: DataFrame) -> DataFrame:
    """``page_id``, ``record`` (text whose UTF-8 bytes are the record) from page_id, url, html."""
    return pages.select("page_id", record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def digest(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def lay_out(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``file``, ``offset`` for rows with ``digest`` and ``length``; all columns are kept.

    Equal rows become one row with their number before the files are laid out
    and are dealt out again behind, so a record that a third of all rows
    repeat is no hot spot.
    """
    columns = records.columns
    alike = records.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    total = records.agg(F.sum("length").alias("t")).first()["t"] or 0
    files = max(1, -(-total // file_bytes))
    spread = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") % files
    order = Window.partitionBy("file").orderBy("digest", *[c for c in columns if c != "digest"])
    start = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0))
    placed = alike.withColumn("file", spread).withColumn("start", start)
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")
    return placed.select(*columns, "file", "start", copy).select(
        *columns, "file", (F.col("start") + F.col("copy") * F.col("length")).cast("bigint").alias("offset"))


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.lit(side).alias("side"), "file", "offset", "length", "digest").filter(
        "file is not null and offset is not null and digest is not null")


def _node_hash(at: str, value: Column) -> Column:
    """Hash over the children (place, hash) in order of their place; equal children count once."""
    children = F.array_sort(F.collect_set(F.struct(F.col(at).alias("at"), value.alias("hash"))))
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"], c["hash"])), ","), 256)


def _pairs(nodes: DataFrame) -> DataFrame:
    """Nodes of both replicas side by side."""
    return nodes.groupBy("file", "at").agg(F.max(F.when(F.col("side") == "a", F.col("hash"))).alias("hash_a"),
                                           F.max(F.when(F.col("side") == "b", F.col("hash"))).alias("hash_b"))


def trees(first: DataFrame, second: DataFrame, stored: Stored) -> list[DataFrame]:
    """Node pairs (file, at, hash_a, hash_b) per level, from the records' ranges to the roots (``at`` 0)."""
    both = _side(first, "a").unionByName(_side(second, "b"))
    nodes = both.withColumn("range", F.shiftright("offset", RANGE_BITS)).groupBy(
        "side", "file", F.col("range").alias("at")).agg(_node_hash("offset", F.concat_ws("/", "length", "digest")).alias("hash"))
    levels = []
    for level in range(LEVELS + 1):
        nodes = stored.put(nodes, f"level-{level}")
        levels.append(_pairs(nodes))
        if level < LEVELS:
            up = F.shiftright("at", FAN_BITS) if level < LEVELS - 1 else F.lit(0).cast("bigint")
            nodes = nodes.groupBy("side", "file", up.alias("up")).agg(
                _node_hash("at", F.col("hash")).alias("hash")).withColumnRenamed("up", "at")
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Damage in ``second`` against ``first`` (both: file, offset, length, digest).

    Returns ``file``, ``offset``, ``length_a``, ``length_b``, ``digest_a``, ``digest_b``, ``status``.
    """
    stored = Stored(get_ready(first.sparkSession), "warc-audit")
    levels = trees(first, second, stored)

    def differs(pairs: DataFrame) -> DataFrame:
        return pairs.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "at")

    bad = differs(levels[-1])
    for level in range(LEVELS - 1, -1, -1):
        up = F.shiftright("at", FAN_BITS) if level < LEVELS - 1 else F.lit(0).cast("bigint")
        below = differs(levels[level]).withColumn("up", up)
        above = bad.select(F.col("file").alias("f"), F.col("at").alias("u"))
        bad = below.join(above, (F.col("file") == F.col("f")) & (F.col("up") == F.col("u")), "left_semi").select("file", "at")
    bad = stored.put(bad, "bad-ranges").select(F.col("file").alias("f"), F.col("at").alias("u"))

    def near(df: DataFrame, side: str) -> DataFrame:
        """Records of the ranges that differ, as a sorted set per place."""
        some = _side(df, side).join(
            bad, (F.col("file") == F.col("f")) & (F.shiftright("offset", RANGE_BITS) == F.col("u")), "left_semi")
        return some.groupBy("file", "offset").agg(
            F.array_sort(F.collect_set(F.struct("digest", "length"))).alias("s")).select(
                "file", "offset", F.array_join(F.col("s.digest"), "+").alias(f"digest_{side}"),
                F.aggregate("s", F.lit(0).cast("bigint"), lambda x, r: x + r["length"]).alias(f"length_{side}"))

    both = near(first, "a").join(near(second, "b"), ["file", "offset"], "full")
    status = (F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra")
              .otherwise("changed"))
    return both.filter(~(F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("length_a").eqNullSafe(F.col("length_b")))) \
        .select("file", "offset", "length_a", "length_b", "digest_a", "digest_b", status.alias("status"))
