"""Workbooks: committed writer (O3), streamed and typed scan."""

import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from rollcall.sinks import workbook as sink
from rollcall.sinks.workbook import write_grid_workbook, write_xlsx
from rollcall.sources import workbook as source

ODD = ["plain", "a<b>&\"c\"", "two\nlines", "tab\there", "bell\x07", "cr\rhere", "_x0041_", "\U0001f600 \U0001f600\x01", "", None]


def _grid(spark, n):
    texts = F.array(*[F.lit(t) for t in ODD])
    return spark.range(n, numPartitions=7).select(
        F.element_at(texts, (F.col("id") % len(ODD) + 1).cast("int")).alias("Text"), F.col("id").alias("Number"),
        (F.col("id") / 4).alias("Half"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("Flag"))


def test_sheets_continue_and_rows_stand_in_order(spark, scratch):
    path = write_grid_workbook(_grid(spark, 1000), scratch, "Grid & more", order=["Number"], sheet_rows=301)
    assert os.listdir(scratch).count(os.path.basename(path)) == 1 and not [f for f in os.listdir(scratch) if f.endswith(".tmp")]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        for i, n in enumerate([301, 301, 301, 101], start=1):
            xml = z.read(f"xl/worksheets/sheet{i}.xml").decode()
            assert [int(r) for r in re.findall(r'<row r="(\d+)"', xml)] == list(range(1, n + 1))
    rows = source.scan_workbooks(spark, scratch, typed=True, sheet_slots=3).collect()
    assert {r.sheet_name for r in rows} == {"Grid & more"} | {f"Grid & more ({i})" for i in (2, 3, 4)}
    assert all(r.cells == ["Text", "Number", "Half", "Flag"] for r in rows if r.row_number == 1)
    found = {r.sheet_index * 300 + r.row_number - 2: r for r in rows if r.row_number > 1}
    assert sorted(found) == list(range(1000))
    for i, r in found.items():
        flag = None if i % 3 == 0 else str(i % 3 == 1)
        want = [ODD[i % len(ODD)], str(i), str(i / 4), flag]
        width = 3 if flag is None else 4
        assert [c or None for c in r.cells] == [c or None for c in want[:width]], i
        assert r.kinds[1:3] == ["number", "number"] and (flag is None or r.kinds[3] == "flag")


def test_empty_grid_is_a_header(spark, scratch):
    write_grid_workbook(_grid(spark, 1).limit(0), scratch)
    assert [r.cells for r in source.scan_workbooks(spark, scratch).collect()] == [["Text", "Number", "Half", "Flag"]]


def test_no_file_is_left_by_a_failed_commit(spark, scratch, monkeypatch):
    monkeypatch.setattr(sink, "SHEET_FOOT", None)
    with pytest.raises(AttributeError):
        write_grid_workbook(_grid(spark, 5), scratch)
    assert os.listdir(scratch) == []


def test_rows_and_cells_without_references_and_many_batches(spark, scratch, monkeypatch):
    rows = "".join(f"<row><c><v>{i}</v></c><c/><c t='inlineStr'><is><t>x{i}</t></is></c></row>" for i in range(50))
    with zipfile.ZipFile(os.path.join(scratch, "bare.xlsx"), "w") as z:
        for name, text in sink._members(["S"]):
            z.writestr(name, text)
        z.writestr("xl/worksheets/sheet1.xml", f"{sink.SHEET_HEAD}{rows}{sink.SHEET_FOOT}")
    with open(os.path.join(scratch, "bare.xlsx"), "rb") as f:
        got = list(source.read_workbook(f.read()))
    assert [(r[2], r[3], r[4]) for r in got] == [(i + 1, [str(i), None, f"x{i}"], ["number", None, "text"]) for i in range(50)]
    monkeypatch.setattr(source, "BATCH_ROWS", 7)
    import pandas as pd
    with open(os.path.join(scratch, "bare.xlsx"), "rb") as f:
        files = pd.DataFrame({"path": ["p"], "content": [f.read()], "slot": [0], "slots": [1]})
    assert [len(b) for b in source._parse(iter([files]))] == [7] * 7 + [1]


def test_sheets_are_dealt_over_slots(spark, scratch):
    write_xlsx(os.path.join(scratch, "five.xlsx"), [(f"S{i}", [[f"r{i}"]]) for i in range(5)])
    for slots in (1, 2, 8):
        rows = source.scan_workbooks(spark, scratch, sheet_slots=slots).collect()
        assert sorted((r.sheet_index, r.sheet_name, r.cells[0]) for r in rows) == [(i, f"S{i}", f"r{i}") for i in range(5)]
