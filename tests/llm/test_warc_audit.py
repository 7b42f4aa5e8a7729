"""Merkle audit against a direct comparison of the replicas."""

from pyspark.sql import functions as F

from rollcall.llm import warc_audit as w
from rollcall.llm.common import Stored


def direct(a, b):
    a, b = {(f, o): (n, d) for f, o, n, d in a}, {(f, o): (n, d) for f, o, n, d in b}
    return sorted((f, o, "missing" if (f, o) not in b else "extra" if (f, o) not in a else "changed")
                  for f, o in a.keys() | b.keys() if a.get((f, o)) != b.get((f, o)))


SCHEMA = "file long, offset long, length long, digest string"


def test_damage_is_located(spark):
    first, at = [], 0
    for i in range(900):
        n = 200 + (i * 7919) % 90000
        first.append((i % 3 // 2, at, n, f"d{i}"))
        at += n
    first.append((0, 1 << 45, 5, "far"))
    second = [(f, o, n, d) for k, (f, o, n, d) in enumerate(first) if k % 211 != 9]
    second = [(f, o, n, "x" if k % 157 == 3 else d) for k, (f, o, n, d) in enumerate(second)]
    second = [(f, o, n + 1 if k == 40 else n, d) for k, (f, o, n, d) in enumerate(second)] + [(5, 0, 9, "new"), (0, 7, 1, "new")]
    a, b = spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA)
    got = sorted((r.file, r.offset, r.status) for r in w.audit(a, b).collect())
    assert got == direct(first, second) and len(got) > 8
    assert w.audit(a, a.union(a.limit(3))).count() == 0
    assert w.audit(a.limit(0), a.limit(0)).count() == 0
    assert {r.status for r in w.audit(a, a.limit(0)).collect()} == {"missing"}
    assert w.audit(a, a.limit(0)).count() == len(first)


def test_roots_tell_replicas_apart(spark):
    rows = [(0, i * 1000, 1000, f"d{i}") for i in range(300)]
    a = spark.createDataFrame(rows, SCHEMA)
    b = a.withColumn("digest", F.when(F.col("offset") == 77000, "bad").otherwise(F.col("digest")))
    levels = w.trees(a, b, Stored(spark, "test-warc"))
    assert [x.filter("hash_a <> hash_b").count() for x in levels] == [1] * len(levels)
    assert levels[-1].count() == 1 and levels[0].count() == 5


def test_layout(spark):
    rows = [(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (2, None, None), (None, "u", "x" * 5000), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = w.write_records(pages)
    for r in records.collect():
        head, body = r.record.encode().split(b"\r\n\r\n", 1)
        size = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert body[size:] == b"\r\n\r\n"
    hashed = records.select(w.digest(F.col("record")).alias("digest"), F.octet_length("record").cast("long").alias("length"))
    for size in (1 << 26, 300):
        placed = w.lay_out(hashed, size).collect()
        assert len(placed) == 5
        by_file = {}
        for r in sorted(placed, key=lambda r: (r.file, r.offset)):
            assert r.offset == by_file.get(r.file, 0)
            by_file[r.file] = r.offset + r.length
    assert w.lay_out(hashed.limit(0)).count() == 0
