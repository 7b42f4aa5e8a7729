"""Delimited-file scan by a quote-parity prefix scan.

A quote toggles between inside and outside of a cell, so whether a line
begins inside a cell is the parity of all quotes before it in its file.  Files
stay splittable: every split counts its quotes, a prefix sum over a file's
splits (one small row each) tells each split how it begins, and lines
inside a split with quoted line breaks are counted on from there.  A record is
the lines from one line that begins outside to the next; only records of
several lines are gathered, all others stay where they were read.

On whole records every file is then judged for itself:

* delimiter: the most frequent of ``, ; TAB |`` outside quotes, in the whole file;
* encoding: UTF-8 (a leading BOM is dropped) unless some line of the file is
  not valid UTF-8, then latin-1;
* width: a record has at least the header's number of cells (short ones are
  filled with ''), and all of its own, trailing empty ones too.

Every cell is a string; the first record is the header (row 1); empty lines
are records of one empty cell.  A line break inside a cell comes as one line
feed.  A quote that is never closed makes the rest of its file one record.
Nothing is read while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.operators.joins import bounded_broadcast

# Candidate delimiters in preference order.
DELIMITERS = [",", ";", "\t", "|"]
BOM = "﻿"
QUOTE = '"'
# Lines hold neither line feeds nor carriage returns, so one stands for a line break inside a record and
# the other for a cell border while a record is taken apart.
BREAK, BORDER = "\r", "\n"


def _times(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("split"),
        F.col("value"), (_times(F.col("value"), QUOTE) % 2).alias("odd"))


def records(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """``path``, ``row_number`` (dense from 1, in file order), ``encoding`` and ``text`` of every record; line breaks inside
    a record are carriage returns.

    Split numbers and line ids are read only directly on the file scan, whose
    splits are deterministic, so every branch and every retry sees the same.
    """
    lines = _lines(spark, path)
    of_file = Window.partitionBy("path")
    so_far = of_file.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)

    def before(c: str) -> Column:
        return F.coalesce(F.sum(c).over(so_far), F.lit(0))

    splits = lines.groupBy("path", "split").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("odd").alias("odds"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8")).select(
        "path", "split", "first", "n", "odds", (before("odds") % 2).alias("inside"), F.bool_and("utf8").over(of_file).alias("utf8"))
    # a split holds a run of each of its files, so there are no more runs than splits and files together
    bound = lines.rdd.getNumPartitions() + len(lines.inputFiles())
    placed = lines.join(bounded_broadcast(splits, bound), ["path", "split"])

    of_split = Window.partitionBy("path", "split").orderBy("at")
    earlier, up_to = of_split.rowsBetween(Window.unboundedPreceding, -1), of_split.rowsBetween(Window.unboundedPreceding, 0)
    broken = (placed.filter("odds > 0")
              .withColumn("starts", ((F.col("inside") + F.coalesce(F.sum("odd").over(earlier), F.lit(0))) % 2 == 0).cast("bigint"))
              .withColumn("nth", F.sum("starts").over(up_to)))
    calm = placed.filter("odds = 0").select(
        "*", (F.lit(1) - F.col("inside")).cast("bigint").alias("starts"),
        F.when(F.col("inside") == 0, F.col("at") - F.col("first") + 1).otherwise(0).alias("nth"))

    begun = broken.groupBy("path", "split").agg(F.sum("starts").alias("begun"))
    offsets = splits.join(begun, ["path", "split"], "left").select(
        "path", "split", "first", F.coalesce("begun", F.col("n") * (1 - F.col("inside"))).alias("begun")).select(
        "path", "split", before("begun").alias("offset"))
    whole = F.lit(encoding == "UTF-8") if encoding else F.col("utf8")
    numbered = calm.unionByName(broken).join(bounded_broadcast(offsets, bound), ["path", "split"]).select(
        "path", "at", (F.col("offset") + F.col("nth")).alias("row_number"), ((F.col("starts") == 1) & (F.col("odd") == 0)).alias("single"),
        F.when(whole, F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding"),
        F.when(whole, F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).alias("value"))
    alone = numbered.filter("single").select("path", "row_number", "encoding", F.col("value").alias("text"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "value")))
    several = numbered.filter(~F.col("single")).groupBy("path", "row_number", "encoding").agg(
        F.array_join(F.transform(in_order, lambda line: line["value"]), BREAK).alias("text"))
    both = alone.unionByName(several)
    return both.withColumn("text", F.when(F.col("row_number") == 1, F.regexp_replace("text", f"^{BOM}", "")).otherwise(F.col("text")))


def _outside(text: Column) -> Column:
    """The text without what stands between quotes."""
    return F.when(F.instr(text, QUOTE) > 0, F.regexp_replace(text, '"[^"]*"', "")).otherwise(text)


def judge(found: DataFrame) -> DataFrame:
    """One row per file: ``path``, ``sep``, ``encoding``, ``width`` (cells of the widest record) and ``header_width``."""
    bare, each = _outside(F.col("text")), range(len(DELIMITERS))
    counted = found.select("path", "row_number", "encoding", *[_times(bare, d).alias(f"n{i}") for i, d in enumerate(DELIMITERS)])
    files = counted.groupBy("path").agg(
        F.min("encoding").alias("encoding"), *[F.sum(f"n{i}").alias(f"s{i}") for i in each],
        *[F.max(f"n{i}").alias(f"m{i}") for i in each], *[F.max(F.when(F.col("row_number") == 1, F.col(f"n{i}"))).alias(f"h{i}") for i in each])
    most = F.greatest(*[F.col(f"s{i}") for i in each])
    best = F.lit(0)
    for i in reversed(each):
        best = F.when((F.col(f"s{i}") == most) & (most > 0), F.lit(i)).otherwise(best)

    def of(kind: str) -> Column:
        return F.element_at(F.array(*[F.col(f"{kind}{i}") for i in each]), F.col("best") + 1)

    return files.withColumn("best", best).select(
        "path", F.element_at(F.array(*[F.lit(d) for d in DELIMITERS]), F.col("best") + 1).alias("sep"), "encoding",
        (of("m") + 1).cast("int").alias("width"), (of("h") + 1).cast("int").alias("header_width"))


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Delimiter, encoding and widths of every file under ``path``."""
    return judge(records(spark, path))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter of one file (of the first by name in a folder)."""
    return profile(spark, path).orderBy("path").first()["sep"]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """Encoding of one file (of the first by name in a folder)."""
    return profile(spark, path).orderBy("path").first()["encoding"]


def cells_of(text: Column, sep: Column) -> Column:
    """The cells of a record.  Delimiters outside quotes become borders; a cell that begins with a quote loses its quotes
    (a doubled one stands for one)."""
    def marked(part: Column) -> Column:
        return F.replace(part, sep, F.lit(BORDER))

    parts = F.transform(F.split(text, QUOTE, -1), lambda part, i: F.when(i % 2 == 0, marked(part)).otherwise(part))
    raw = F.split(F.when(F.instr(text, QUOTE) > 0, F.array_join(parts, QUOTE)).otherwise(marked(text)), BORDER, -1)

    def value(cell: Column) -> Column:
        inner = F.replace(F.replace(F.substr(cell, F.lit(2)), F.lit(QUOTE * 2), F.lit(BORDER)), F.lit(QUOTE), F.lit(""))
        return F.when(F.startswith(cell, F.lit(QUOTE)), F.translate(inner, BORDER + BREAK, QUOTE + "\n")).otherwise(
            F.translate(cell, BREAK, "\n"))

    return F.when(F.instr(text, QUOTE) > 0, F.transform(raw, value)).otherwise(raw)


def scan_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   width: int | None = None) -> DataFrame:
    """Rows of the files under ``path`` in the common row shape.  ``sep`` and
    ``encoding`` override what the files show; ``width`` fixes the number of
    cells of every row (default: all cells of the record, at least as many
    as the file's header has)."""
    found = records(spark, path, encoding)
    if sep:
        heads = found.filter("row_number = 1").select(
            "path", F.lit(sep).alias("sep"), (_times(_outside(F.col("text")), sep) + 1).alias("header_width"))
    else:
        heads = judge(found).select("path", "sep", "header_width")
    # one row per file of the listing
    cut = found.join(bounded_broadcast(heads, len(found.inputFiles())), "path").select("path", "row_number", "header_width", cells_of(F.col("text"), F.col("sep")).alias("cells"))
    size = F.lit(width) if width else F.greatest(F.col("header_width"), F.size("cells"))
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(size - F.size("cells"), F.lit(0)).cast("int")))
    return cut.select("path", F.lit(0).alias("sheet_index"), F.regexp_extract("path", r"([^/]+)$", 1).alias("sheet_name"),
                      "row_number", (F.slice(filled, 1, width) if width else filled).alias("cells"))
