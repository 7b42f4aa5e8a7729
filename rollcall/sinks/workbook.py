"""A report grid as a spreadsheet workbook (O3, spreadsheet target).

The reference writes its slot report to an online spreadsheet; here the grid
becomes an ``.xlsx`` workbook.  Tasks turn their range of rows into sheet XML
(column expressions, inline text and numeric cells) and write it as text
parts, which Spark commits task by task, so a lost or repeated task leaves
nothing behind.  The commit then streams the parts, in order and 64 KB at a
time, into the members of one zip beside the target and renames it: no rows
reach Python on the driver, and memory doesn't grow with the grid.  Rows
beyond the format's limit of a sheet go on in further sheets.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.ordering import with_position
from rollcall.sinks.writers import delete, file_system, scratch_path

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
_XML = '<?xml version="1.0" encoding="UTF-8"?>'
SHEET_HEAD = f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>'
SHEET_FOOT = "</sheetData></worksheet>"
# Fixed value: rows of one sheet in the workbook format, the header among them.
SHEET_ROWS = 1_048_576
COPY_BYTES = 1 << 16
# characters XML 1.0 can't hold, and the carriage return, which parsers turn into a line break
_UNWRITABLE = "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"


def _column_letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return f'<c r="{ref}"><v>{v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def _members(names: list[str]) -> list[tuple[str, str]]:
    """The zip members beside the sheets: (name, text)."""
    sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>'
                     for i, n in enumerate(names, start=1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>'
                   for i in range(1, len(names) + 1))
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>'
                    for i in range(1, len(names) + 1))
    return [
        ("[Content_Types].xml",
         f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
         '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
         '<Default Extension="xml" ContentType="application/xml"/>'
         f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>'),
        ("_rels/.rels", f'{_XML}<Relationships xmlns="{_PKG}"><Relationship Id="rId1" Type="{_REL}/officeDocument" '
                        'Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PKG}">{rels}</Relationships>')]


def xlsx_bytes(sheets: list[tuple[str, list[list]]]) -> bytes:
    """``[(sheet name, rows)]`` as workbook bytes; row 1 of each sheet is its
    first list."""
    buf = io.BytesIO()
    write_xlsx(buf, sheets)
    return buf.getvalue()


def _row(number: int, values) -> str:
    cells = "".join(_cell(f"{_column_letters(c)}{number}", v) for c, v in enumerate(values))
    return f'<row r="{number}">{cells}</row>'


def write_xlsx(path, sheets: list[tuple[str, list[list]]]) -> None:
    """Write ``[(sheet name, rows)]`` as a workbook to a path or file object."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _members([n for n, _ in sheets]):
            z.writestr(name, text)
        for i, (_, rows) in enumerate(sheets, start=1):
            body = "".join(_row(r, row) for r, row in enumerate(rows, start=1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"{SHEET_HEAD}{body}{SHEET_FOOT}")


def _escaped(text: Column) -> Column:
    """Text for an XML element; what XML can't hold is written as ``_xHHHH_``, and a ``_xHHHH_`` of the text itself with
    its first character in that form."""
    text = F.regexp_replace(text, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    coded = F.array_join(F.transform(chars, lambda c: F.when(
        c.rlike(_UNWRITABLE), F.concat(F.lit("_x"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0"), F.lit("_"))).otherwise(c)), "")
    text = F.when(text.rlike(_UNWRITABLE), coded).otherwise(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _cell_column(field: T.StructField, letters: str, row: Column) -> Column:
    value = F.col(f"`{field.name}`")
    ref = F.concat(F.lit(f'<c r="{letters}'), row)
    text = F.concat(ref, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), _escaped(value.cast("string")), F.lit("</t></is></c>"))
    if isinstance(field.dataType, T.BooleanType):
        cell = F.concat(ref, F.lit('" t="b"><v>'), value.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(field.dataType, T.NumericType):
        cell = F.concat(ref, F.lit('"><v>'), value.cast("string"), F.lit("</v></c>"))
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            # no number of the format: an empty cell, or the word
            cell = F.when(F.isnan(value), F.lit("")).when(F.abs(value) == float("inf"), text).otherwise(cell)
    else:
        cell = text
    return F.coalesce(cell, F.lit(""))


def write_grid_workbook(grid: DataFrame, folder: str, sheet_name: str = "Sheet1",
                        order: list[str] | None = None, sheet_rows: int = SHEET_ROWS) -> str:
    """Write a grid (e.g. ``writers.report_grid``) as one workbook in ``folder``, header row first in every sheet, rows
    by ``order`` and then by all other columns that can be sorted; returns the file path.  Sheets beyond the first are
    called ``<sheet_name> (2)`` and so on."""
    if sheet_rows < 2:
        raise ValueError("sheet_rows must leave room for a header and a row")
    spark = grid.sparkSession
    first = [F.col(f"`{c}`") for c in order or []]
    rest = [F.col(f"`{f.name}`") for f in grid.schema
            if f.name not in (order or []) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    placed = with_position(grid, [*first, *rest], "__n", start=0)
    per_sheet = sheet_rows - 1
    row = (F.col("__n") % per_sheet + 2).cast("string")
    cells = [_cell_column(f, _column_letters(i), row) for i, f in enumerate(grid.schema)]
    lines = placed.repartitionByRange("__n").select(
        (F.floor(F.col("__n") / per_sheet) + 1).cast("int").alias("__sheet"), "__n",
        F.concat(F.lit('<row r="'), row, F.lit('">'), *cells, F.lit("</row>")).alias("value"))
    parts = scratch_path(spark, "sheet-parts")
    # parts are read in the order of their names, which is the order of their ranges
    lines.sortWithinPartitions("__sheet", "__n").select("__sheet", "value").write.partitionBy("__sheet").text(parts)
    path = f"{folder.rstrip('/')}/grid-{uuid.uuid4().hex[:12]}.xlsx"
    try:
        _commit(spark, parts, path, sheet_name, _row(1, grid.columns))
    finally:
        delete(spark, parts)
    return path


def _commit(spark, parts: str, path: str, sheet_name: str, header: str) -> None:
    """Join the parts to a workbook under a hidden name, then rename it."""
    fs, target, jvm = file_system(spark, path)
    sheets = []
    while fs.exists(here := jvm.org.apache.hadoop.fs.Path(f"{parts}/__sheet={len(sheets) + 1}")):
        files = [s.getPath() for s in fs.listStatus(here)]
        sheets.append(sorted((f for f in files if f.getName().startswith("part-")), key=lambda f: f.getName()))
    sheets = sheets or [[]]
    names = [sheet_name if i == 1 else f"{sheet_name} ({i})" for i in range(1, len(sheets) + 1)]
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.tmp")
    archive = jvm.java.util.zip.ZipOutputStream(fs.create(draft, True))
    try:
        try:
            for name, text in _members(names):
                archive.putNextEntry(jvm.java.util.zip.ZipEntry(name))
                archive.write(bytearray(text.encode()))
            for i, files in enumerate(sheets, start=1):
                archive.putNextEntry(jvm.java.util.zip.ZipEntry(f"xl/worksheets/sheet{i}.xml"))
                archive.write(bytearray((SHEET_HEAD + header).encode()))
                for f in files:
                    stream = fs.open(f)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, archive, COPY_BYTES, False)
                    finally:
                        stream.close()
                archive.write(bytearray(SHEET_FOOT.encode()))
        finally:
            archive.close()
        if not fs.rename(draft, target):
            raise OSError(f"can't rename {draft} to {target}")
    except BaseException:
        fs.delete(draft, False)
        raise
