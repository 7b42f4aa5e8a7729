"""Workbook scan over a folder of ``.xlsx`` files.

Each file is one ``binaryFile`` row; ``mapInPandas`` opens it with the
standard library (``zipfile`` + ``xml.etree``) and emits one row per sheet
row in the common row shape, with cached cell values (no formulas are
evaluated), date-formatted numbers as date-time text, and 1-based row
numbers (a row without its number follows the one before).

A task holds the file as stored, its shared strings and one batch of rows:
sheet XML is inflated and parsed as a stream.  Files are spread over tasks by
Spark's splits; ``sheet_slots`` deals the sheets of each file over that many
tasks more, which read the file again but parse only their own sheets.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.rows import ROWS_SCHEMA

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
_SI, _ROW, _SHEET_DATA = (f"{{{_NS['m']}}}{tag}" for tag in ("si", "row", "sheetData"))
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text) if "_x" in text else text


def _text(node) -> str:
    return _unescaped("".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t")))


def _number(v: str) -> str:
    try:
        f = float(v)
    except ValueError:
        return v
    return str(int(f)) if f.is_integer() and "e" not in v.lower() and "." not in v else str(f)


# Built-in number formats that show dates or times.
BUILTIN_DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}
_DATE_CODE = re.compile(r"[dmyhs]", re.I)
_EXCEL_EPOCH = datetime.datetime(1899, 12, 30)


def _date_styles(z: zipfile.ZipFile, names: set[str]) -> set[int]:
    """Indexes of cell styles whose number format is a date or time."""
    if "xl/styles.xml" not in names:
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = set()
    for fmt in root.findall("m:numFmts/m:numFmt", _NS):
        code = re.sub(r'"[^"]*"|\[[^]]*\]|\\.', "", fmt.get("formatCode", ""))
        if _DATE_CODE.search(code):
            custom.add(int(fmt.get("numFmtId")))
    dates = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in BUILTIN_DATE_FORMATS or fid in custom:
            dates.add(i)
    return dates


def _serial_to_text(v: str) -> str:
    """A date serial (1900 date system) as ``YYYY-MM-DD HH:MM:SS``, the text
    form of the datetime a workbook reader returns for a date cell."""
    moment = _EXCEL_EPOCH + datetime.timedelta(seconds=round(float(v) * 86400))
    return moment.strftime("%Y-%m-%d %H:%M:%S")


# Fixed value: the format's escape of a character XML can't hold.
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
# rows and characters of one batch handed to Spark
BATCH_ROWS = 4096
BATCH_CHARS = 4 << 20
# what a cell holds
TEXT, NUMBER, FLAG, DATE = "text", "number", "flag", "date"


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, node in ET.iterparse(f):
            if node.tag == _SI:
                out.append(_text(node))
                node.clear()
    return out


def _cell_value(c, shared: list[str], date_styles: set[int]) -> tuple[str | None, str | None]:
    """(value as text, kind) of a cell element; both None for an empty cell."""
    t = c.get("t")
    if t == "inlineStr":
        inline = c.find("m:is", _NS)
        return (None, None) if inline is None else (_text(inline), TEXT)
    v = c.find("m:v", _NS)
    if v is None or (v.text is None and t != "b"):
        return None, None
    if t == "s":
        return shared[int(v.text)], TEXT
    if t == "b":
        return ("True" if v.text == "1" else "False"), FLAG
    if t in ("str", "e"):
        return _unescaped(v.text), TEXT
    if t == "d":
        return v.text, DATE
    if int(c.get("s", "0")) in date_styles:
        return _serial_to_text(v.text), DATE
    return _number(v.text), NUMBER


def _sheet_rows(z: zipfile.ZipFile, part: str, shared: list[str], date_styles: set[int]) -> Iterator[tuple[int, list, list]]:
    """(row_number, cells, kinds) of the rows stored in a sheet, read as a stream."""
    number, data = 0, None
    with z.open(part) as f:
        for event, node in ET.iterparse(f, events=("start", "end")):
            if node.tag == _SHEET_DATA:
                data = node
            if event == "start" or node.tag != _ROW:
                continue
            number = int(node.get("r", number + 1))
            cells: dict[int, tuple] = {}
            following = 0
            for c in node.findall("m:c", _NS):
                m = _REF.match(c.get("r", ""))
                at = _col_index(m.group(1)) if m else following
                following = at + 1
                cells[at] = _cell_value(c, shared, date_styles)
            width = max(cells) + 1 if cells else 0
            found = [cells.get(i, (None, None)) for i in range(width)]
            yield number, [v for v, _ in found], [k for _, k in found]
            if data is not None:
                data.clear()


def read_workbook(content: bytes, slot: int = 0, slots: int = 1) -> Iterator[tuple[int, str, int, list, list]]:
    """(sheet_index, sheet_name, row_number, cells, kinds) for every stored row of the sheets whose index leaves ``slot``
    when divided by ``slots``.  Numeric cells with a date number format come back as date-time text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        mine = [(i, s) for i, s in enumerate(wb.findall("m:sheets/m:sheet", _NS)) if i % slots == slot]
        if not mine:
            return
        date_styles = _date_styles(z, names)
        shared = _shared_strings(z) if "xl/sharedStrings.xml" in names else []
        rels = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for rel in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", _NS):
                rels[rel.get("Id")] = rel.get("Target")
        for idx, sheet in mine:
            target = rels.get(sheet.get(f"{{{_NS['r']}}}id"), f"worksheets/sheet{idx + 1}.xml")
            part = target.lstrip("/") if target.startswith("/") else "xl/" + target
            if part in names:
                for row in _sheet_rows(z, part, shared, date_styles):
                    yield idx, sheet.get("name"), *row


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet_index", "sheet_name", "row_number", "cells", "kinds"]
    rows, chars = [], 0
    for pdf in batches:
        for path, content, slot, slots in zip(pdf["path"], pdf["content"], pdf["slot"], pdf["slots"], strict=True):
            for row in read_workbook(bytes(content), int(slot), int(slots)):
                rows.append((path, *row))
                chars += sum(len(v) for v in row[3] if v)
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, chars = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def scan_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx", typed: bool = False, sheet_slots: int = 1) -> DataFrame:
    """The rows of every workbook in ``path`` in the common row shape; ``typed`` adds ``kinds``, what each cell holds
    (``text``, ``number``, ``flag``, ``date``; null for an empty cell)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return workbook_rows(files, typed, sheet_slots)


def workbook_rows(files: DataFrame, typed: bool = False, sheet_slots: int = 1) -> DataFrame:
    """``scan_workbooks`` of workbooks that stand in a table (``path``, ``content`` binary); a null content has no rows."""
    files = files.filter("content IS NOT NULL")
    slots = [files.select("path", "content", F.lit(s).alias("slot"), F.lit(sheet_slots).alias("slots")) for s in range(sheet_slots)]
    rows = reduce(DataFrame.unionAll, slots).mapInPandas(_parse, f"{ROWS_SCHEMA}, kinds array<string>")
    return rows if typed else rows.drop("kinds")
