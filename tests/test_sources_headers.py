import os

from pyspark.sql import functions as F

from rollcall.operators import headers as H
from rollcall.operators import sheet_parse as SP
from rollcall.operators.headers import FORM_HEADERS, PROJECT_HEADERS
from rollcall.sources import delimited, sheets, workbook
from rollcall.sources.rows import headers as header_table
from xlsx_writer import write_xlsx


def test_csv_sniff_bom_and_row_numbers(spark, scratch):
    path = os.path.join(scratch, "people.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("Email;Name;Phone\n")
        f.write("a@b.co;Ann;+91 98765-43210\n")
        f.write(";;\n")
        f.write("bad;Bob;1\n")
    rows = delimited.scan_delimited(spark, path)
    got = sorted((r.row_number, r.cells) for r in rows.collect())
    assert got[0] == (1, ["Email", "Name", "Phone"])
    assert got[1] == (2, ["a@b.co", "Ann", "+91 98765-43210"])
    assert [g[0] for g in got] == [1, 2, 3, 4]
    assert delimited.sniff_delimiter(spark, path) == ";"


def test_csv_latin1(spark, scratch):
    path = os.path.join(scratch, "latin.csv")
    with open(path, "wb") as f:
        f.write("name,city\nJos\xe9,S\xe3o Paulo\n".encode("latin-1"))
    assert delimited.detect_encoding(spark, path) == "ISO-8859-1"
    rows = delimited.scan_delimited(spark, path).filter(F.col("row_number") == 2).first()
    assert rows.cells == ["Jos\xe9", "S\xe3o Paulo"]


def test_every_file_is_judged_for_itself(spark, scratch):
    """Delimiter, encoding, width and line breaks differ between the files of a folder; no cell or row is lost."""
    files = {"a.csv": "name;age\nAnn;3\n".encode(), "b.csv": "name,age\nBob,4\nCy,5,extra,\n".encode(),
             "c.csv": "name,city\nJos\xe9,S\xe3o\n".encode("latin-1"), "d.csv": "name,city\nJosé,São\n".encode(),
             "e e.csv": b'name,note\nDee,"two\nlines, here"\nEve,"a ""q"" b"\n', "f.csv": b"a|b|c|d|e\n1|2|3|4|5\n|||4|\n",
             "g.csv": b"one\nx\n"}
    for name, data in files.items():
        with open(os.path.join(scratch, name), "wb") as f:
            f.write(data)
    rows = delimited.scan_delimited(spark, scratch).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.sheet_name, r.row_number)):
        got.setdefault(r.sheet_name, []).append((r.row_number, r.cells))
    assert got["a.csv"] == [(1, ["name", "age"]), (2, ["Ann", "3"])]
    assert got["b.csv"] == [(1, ["name", "age"]), (2, ["Bob", "4"]), (3, ["Cy", "5", "extra", ""])]
    assert got["c.csv"] == [(1, ["name", "city"]), (2, ["José", "São"])] == got["d.csv"]
    spaced = next(v for k, v in got.items() if k.startswith("e"))
    assert spaced == [(1, ["name", "note"]), (2, ["Dee", "two\nlines, here"]), (3, ["Eve", 'a "q" b'])]
    assert got["f.csv"] == [(1, list("abcde")), (2, list("12345")), (3, ["", "", "", "4", ""])]
    assert got["g.csv"] == [(1, ["one"]), (2, ["x"])]


def _python_rows(data, sep):
    import csv
    import io
    return list(csv.reader(io.StringIO(data, newline=""), delimiter=sep))


def test_quoted_breaks_keep_their_structure(spark, scratch):
    probes = {"a.csv": 'a,b\n"x\n;;;;;;",1\n', "b.csv": "a,b,c\n1,2,3,,\n,,\n\n4\n",
              "c.csv": 'k;v\n1;"he said ""no"""\n2;""\n3;"""";\n4;"a;b\n\n;c"\n',
              "d.csv": 'x\ty\n"1\n2"\t"\n"\n"3"\t4\t\n'}
    for name, data in probes.items():
        with open(os.path.join(scratch, name), "w", newline="") as f:
            f.write(data)
    got = {}
    for r in sorted(delimited.scan_delimited(spark, scratch).collect(), key=lambda r: r.row_number):
        got.setdefault(r.sheet_name, []).append(r.cells)
    for name, sep in (("a.csv", ","), ("b.csv", ","), ("c.csv", ";"), ("d.csv", "\t")):
        want = _python_rows(probes[name], sep)
        width = len(want[0])
        assert got[name] == [r + [""] * (width - len(r)) for r in want], name


def test_records_over_many_splits(spark, scratch):
    """Quoted line breaks in most records; splits begin inside cells, and a record covers several whole splits."""
    import random
    rng = random.Random(5)
    rows = [["k", "note", "end"]]
    for i in range(4000):
        note = "".join(rng.choice(["word ", ",", "\n", '"', "", "x;y"]) for _ in range(rng.choice([0, 2, 9])))
        rows.append([str(i), note * (3000 if i == 1500 else 1), ""])
    path = os.path.join(scratch, "quoted.csv")
    with open(path, "w", newline="") as f:
        for r in rows:
            f.write(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = delimited.scan_delimited(spark, path)
        got = [(r.row_number, r.cells) for r in found.orderBy("row_number").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i + 1, r) for i, r in enumerate(rows)]


def test_row_numbers_dense_across_splits(spark, scratch):
    path = os.path.join(scratch, "big.csv")
    n = 60000
    with open(path, "w") as f:
        f.write("k,v\n")
        for i in range(n):
            f.write(f"{i},x{i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = delimited.scan_delimited(spark, path, sep=",", encoding="UTF-8")
        assert rows.rdd.getNumPartitions() > 1
        bad = rows.filter((F.col("row_number") > 1)
                          & (F.col("cells")[0].cast("long") + 2 != F.col("row_number"))).count()
        assert bad == 0
        assert rows.agg(F.max("row_number")).first()[0] == n + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _master_workbook(path):
    sheets_ = []
    for i, (role, ws) in enumerate(sheets.SHEET_ROLES):
        if role == "form":
            rows = [FORM_HEADERS,
                    ["T1", "Lead", "lead@x.io", "", "3", "P", "Ann", " ANN@Example.com ", "25 Nov, 4:00 - 7:00 PM",
                     "2025-09-12T11:52:26.894Z", "", "", "", "", ""],
                    [None] * 15,
                    ["T2", "Lead", "lead@x.io", "", "3", "P", "", "x@y.io", "", "", "", "", "", "", ""],
                    ["T3", "Lead", "lead@x.io", "", "3", "P", "Cy", "not-an-email", "", "", "", "", "", "", ""]]
        else:
            rows = [PROJECT_HEADERS,
                    ["T1", "Lead", "lead@x.io", "", "3", "P", "proof", "https://community.aws/p/1", "01/02/2024",
                     "", "", "", "", ""]]
        sheets_.append((f"Sheet{i + 1}", rows))
    write_xlsx(path, sheets_)


def test_workbook_roles_and_sheet_parse(spark, scratch):
    _master_workbook(os.path.join(scratch, "master.xlsx"))
    rows = workbook.scan_workbooks(spark, scratch)
    assert rows.select("sheet_index").distinct().count() == 12
    roled = sheets.sheet_roles(rows)
    assert roled.filter(F.col("role_error").isNotNull()).count() == 0
    forms, ferr = SP.parse_form_sheets(roled, 2024, "2025-01-15 09:30:00")
    # the lookup picks the first header containing "Email"/"Name": the leader's columns
    recs = forms.collect()
    assert len(recs) == 6 * 3  # three non-blank rows per form sheet, leader columns are valid
    assert {r.email for r in recs} == {"lead@x.io"}
    assert {r.workshop_name for r in recs} == {f"Workshop {w}" for w in range(1, 7)}
    assert ferr.count() == 0
    projects, perr = SP.parse_project_sheets(roled, 2024, "2025-01-15 09:30:00")
    p = projects.filter(F.col("workshop_name") == "Workshop 1").first()
    assert p.project_link == "https://community.aws/p/1" and p.valid is False and p.team_id == "T1"
    assert str(p.created_at) == "2024-02-01 00:00:00"


def test_too_few_sheets(spark, scratch):
    write_xlsx(os.path.join(scratch, "small.xlsx"), [("A", [["x"]]), ("B", [["y"]])])
    roled = sheets.sheet_roles(workbook.scan_workbooks(spark, scratch))
    assert roled.filter(F.col("role").isNotNull()).count() == 0
    assert roled.first().role_error == "Expected 12 sheets, found 2"


def _headers(spark, names):
    rows = spark.createDataFrame([("f", 0, "s", 1, names)], "path string, sheet_index int, sheet_name string, "
                                                             "row_number long, cells array<string>")
    return header_table(rows)


def test_lookup_first_substring(spark):
    h = _headers(spark, FORM_HEADERS)
    r = H.lookup_columns(h, {"name": ["Name"], "email": ["Email"]}).first()
    assert (r.name, r.email) == (0, 2)


def test_validate_headers(spark):
    v = H.validate_headers(_headers(spark, ["Email", "Team"]), "project").first()
    assert v.errors == ["Expected at least 14 columns, got 2", "Missing critical header: Name",
                        "Missing critical header: Team Name",
                        "Missing critical header: AWS Builder Center Blog Link"]


def test_best_pattern_auto_map(spark):
    h = _headers(spark, ["Timestamp", "Email Address", "GitHub Repository URL", "Blog Post", "Created On", "Mail"])
    got = {r.field: r.header for r in H.auto_map_best_pattern(h).collect()}
    assert got == {"email": "Email Address", "github_link": "GitHub Repository URL", "blog_link": "Blog Post",
                   "created_at": "Created On"}


def test_similar_auto_map_last_wins(spark):
    h = _headers(spark, ["email", "Email Address", "name"])
    got = {r.field: r.position for r in H.auto_map_similar(h, ["email", "name"]).collect()}
    assert got == {"email": 1, "name": 2}


def test_weekly_sheet_names(spark):
    df = spark.createDataFrame([("p", i, n, 1, ["x"]) for i, n in enumerate(
        ["Kiro Week 1 Challenge", "13.Kiro Week 1 Challenge", "15.Kiro Week 3 Challenge  The", "Week 3"])],
        "path string, sheet_index int, sheet_name string, row_number long, cells array<string>")
    got = sorted((r.sheet_name, r.week_number) for r in sheets.weekly_sheets(df).collect())
    assert got == [("13.Kiro Week 1 Challenge", 1), ("15.Kiro Week 3 Challenge  The", 3), ("Kiro Week 1 Challenge", 1)]


def test_preview(spark):
    df = spark.createDataFrame([("p", 0, "s", i, ["h"] if i == 1 else ([""] if i == 3 else [str(i)]))
                                for i in range(1, 9)],
                               "path string, sheet_index int, sheet_name string, row_number long, cells array<string>")
    pv = sheets.preview(df, 3).collect()
    assert sorted(r.row_number for r in pv) == [2, 4]
    assert pv[0].total_rows == 7


def test_weekly_sheet_import(spark, scratch):
    write_xlsx(os.path.join(scratch, "weekly.xlsx"), [
        ("Intro", [["x"], ["y"]]),
        ("13.Kiro Week 2 Challenge", [
            ["Timestamp", "Email Address", "GitHub Repository URL", "Blog Post", "Created On"],
            ["t", " A@X.io ", "https://github.com/a/b", "", "2024-01-05 10:00"],
            ["t", "", "https://github.com/c/d", "https://community.aws/x", ""],
            ["t", "bad", "", "", ""]]),
    ])
    rows = workbook.scan_workbooks(spark, scratch)
    recs, errs = SP.parse_weekly_sheets(rows, 2024)
    r = recs.first()
    assert (r.week_number, r.email, r.github_link, r.blog_link) == (2, "a@x.io", "https://github.com/a/b", None)
    assert str(r.created_at) == "2024-01-05 10:00:00"
    assert sorted(e.error for e in errs.collect()) == ["Row 3: Missing email", "Row 4: Invalid email: bad"]


def test_lab_rows(spark):
    rows = spark.createDataFrame(
        [("f", 0, "s", 1, ["Email", "Name", "Valid", "Assigned"]),
         ("f", 0, "s", 2, ["a@x.io", "Ann", "true", "01/02/2024"]),
         ("f", 0, "s", 3, ["b@x.io", "Bob", "yes", ""]),
         ("f", 0, "s", 4, ["c@x.io", "", "TRUE", ""])],
        "path string, sheet_index int, sheet_name string, row_number long, cells array<string>")
    pos = spark.createDataFrame([("f", 0, 0, 1, 2, 3)],
                                "path string, sheet_index int, email int, name int, valid int, assigned_at int")
    recs, errs = SP.parse_lab_rows(rows, pos, 2024, "Workshop 3")
    got = {r.email: (r.valid, str(r.assigned_at)) for r in recs.collect()}
    assert got == {"a@x.io": (True, "2024-02-01 00:00:00"), "b@x.io": (False, "None")}
    assert [e.error for e in errs.collect()] == ["Row 4: Missing email or name"]


def test_lookup_prefer_exact(spark):
    h = _headers(spark, FORM_HEADERS)
    r = H.lookup_columns(h, {"name": ["Name"], "email": ["Email"]}, prefer_exact=True).first()
    assert (r.name, r.email) == (6, 7)  # the member's own columns


def test_form_parse_prefer_exact(spark, scratch):
    _master_workbook(os.path.join(scratch, "master.xlsx"))
    roled = sheets.sheet_roles(workbook.scan_workbooks(spark, scratch))
    forms, ferr = SP.parse_form_sheets(roled, 2024, "2025-01-15 09:30:00", prefer_exact=True)
    recs = forms.filter(F.col("workshop_name") == "Workshop 1").collect()
    assert [(r.email, r.name, str(r.time_slot)) for r in recs] == [("ann@example.com", "Ann", "2024-11-25 16:00:00")]
    errs = sorted(e.error for e in ferr.filter(F.col("sheet_index") == 1).collect())
    assert errs == ["Row 4: Missing name or email", "Row 5: Invalid email format: not-an-email"]


def test_best_pattern_repeated_header_name(spark):
    h = _headers(spark, ["Email", "Email", "Blog"])
    got = {r.field: (r.header, r.position) for r in H.auto_map_best_pattern(h).collect()}
    # the name is used up by the first field; its first occurrence is the mapped column
    assert got == {"email": ("Email", 0), "blog_link": ("Blog", 2)}


def test_similar_auto_map_repeated_name(spark):
    h = _headers(spark, ["x", "email", "email"])
    got = {r.field: r.position for r in H.auto_map_similar(h, ["email"]).collect()}
    assert got == {"email": 1}


def test_generic_import_rows_by_header_name(spark):
    from rollcall.operators import imports as IM
    rows = spark.createDataFrame(
        [("f", 0, "s", 1, ["E-mail", "Full Name", "Joined", "Full Name"]),
         ("f", 0, "s", 2, [" A@X.io ", "Ann", "2024-01-05 10:00", "ignored"]),
         ("f", 0, "s", 3, ["bad", "Bob", "", ""]),
         ("f", 0, "s", 4, ["", "", "", ""])],
        "path string, sheet_index int, sheet_name string, row_number long, cells array<string>")
    recs, rej = IM.generic_import_rows(rows, "participants",
                                       {"email": "E-mail", "name": "Full Name", "registration_date_time": "Joined",
                                        "linkedin": "Missing Column"},
                                       2024, "2025-01-15 09:30:00", defaults=["registration_date_time"])
    r = recs.first()
    assert (r.email, r.name, str(r.registration_date_time), r.path) == ("a@x.io", "Ann", "2024-01-05 10:00:00", "f")
    assert r.linkedin is None  # a mapped name missing from the sheet is skipped
    assert [(x.sheet_index, x.error) for x in rej.collect()] == [(0, "Row 3: Invalid email: bad")]


def test_workbook_date_cells(spark, scratch):
    import zipfile
    path = os.path.join(scratch, "dates.xlsx")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/'
                                      'officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" '
                                      'r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/'
                   '2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" '
                   'formatCode="dd/mm/yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
                   '<xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>'
                   '<row r="1"><c r="A1" t="inlineStr"><is><t>Joined</t></is></c></row>'
                   '<row r="2"><c r="A2" s="1"><v>45296</v></c><c r="B2" s="2"><v>45296.75</v></c>'
                   '<c r="C2"><v>45296</v></c></row></sheetData></worksheet>')
    row = workbook.scan_workbooks(spark, scratch).filter(F.col("row_number") == 2).first()
    assert row.cells == ["2024-01-05 00:00:00", "2024-01-05 18:00:00", "45296"]
