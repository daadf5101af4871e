"""The workbook data source: what it reads, what it leaves unread, and plain workbooks written and read again."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.sources import workbook, workbook_source

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _book(path, sheets, names="", styles="", more=None, hidden=()):
    with zipfile.ZipFile(path, "w") as z:
        states = lambda n: ' state="hidden"' if n in hidden else ""
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"{states(n)}/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{listed}</sheets>{names}</workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        for i, xml in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}>{xml}")
        for name, text in (more or {}).items():
            z.writestr(name, text)


@pytest.fixture(scope="module")
def read(spark):
    workbook_source.register(spark)
    return lambda path, **options: spark.read.format("workbook").options(**options).load(str(path))


def test_filters_leave_sheets_and_rows_unread(read, tmp_path):
    good = '<sheetData><row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2"><v>2</v></c></row></sheetData></worksheet>'
    # After its third row this sheet is no XML; the other never is.
    torn = '<sheetData><row r="1"><c r="A1"><v>7</v></c></row><row r="3"><c r="A3"><v>9</v></c></row><row r="4"><c r="A4"><v>0</v></c></row>' + " " * 100_000 + "<broken"
    _book(tmp_path / "a.xlsx", {"Good": good, "Torn": torn, "Bad": "<<"})
    for split in (0, 8 << 20):
        rows = lambda where, split=split: read(tmp_path, splitBytes=split).filter(where).select("sheet", "row", "num", "error").collect()
        assert [tuple(r) for r in rows("sheet = 'Good'")] == [("Good", 1, 1.0, None), ("Good", 2, 2.0, None)]
        assert [tuple(r) for r in rows("sheet = 'Good' and row > 1")] == [("Good", 2, 2.0, None)]
        assert sorted(tuple(r) for r in rows("sheet in ('Good', 'Torn') and row < 2")) == [("Good", 1, 1.0, None), ("Torn", 1, 7.0, None)]
        assert [r for r in rows("error is not null")] and {r.error.split(":")[0] for r in rows("error is not null")} == {"ParseError"}
    assert read(tmp_path, splitBytes=0).rdd.getNumPartitions() == 3 and read(tmp_path).rdd.getNumPartitions() == 1


def test_objects_over_ranges(read, tmp_path):
    sheet = """<cols><col min="2" max="3" hidden="1"/></cols><sheetData><row r="5" hidden="1"><c r="A5"><v>1</v></c></row></sheetData>
<mergeCells><mergeCell ref="A1:B2"/></mergeCells><conditionalFormatting sqref="C1:C9 E1"><cfRule type="cellIs" priority="1" operator="lessThan"><formula>0.5</formula></cfRule></conditionalFormatting>
<dataValidations><dataValidation type="whole" operator="between" sqref="D1:D4"><formula1>1</formula1><formula2>9</formula2></dataValidation></dataValidations></worksheet>"""
    names = "<definedNames><definedName name=\"both\">'It''s'!$A$1:$B$2,Plain!$C:$C</definedName><definedName name=\"own\" localSheetId=\"1\">Plain!$A$1</definedName><definedName name=\"sum\">SUM(1)</definedName></definedNames>"
    more = {
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships><Relationship Id="t" Type="{REL}/table" Target="../tables/table1.xml"/></Relationships>',
        "xl/tables/table1.xml": f'<table {NS} name="t_1" displayName="Sales" ref="A1:C3"><tableColumns><tableColumn name="a"/><tableColumn name="b"/></tableColumns></table>',
    }
    _book(tmp_path / "a.xlsx", {"It's": sheet, "Plain": "<sheetData/></worksheet>"}, names, more=more, hidden=("Plain",))
    found = {(r.sheet, r.kind, r["name"], r.ref): r for r in read(tmp_path, part="objects").collect()}
    assert set(found) == {
        ("It's", "hidden_columns", None, "B:C"), ("It's", "hidden_rows", None, "5:5"), ("It's", "merged", None, "A1:B2"), ("It's", "conditional_format", None, "C1:C9"), ("It's", "conditional_format", None, "E1"),
        ("It's", "validation", None, "D1:D4"), ("It's", "table", "Sales", "A1:C3"), ("It's", "name", "both", "$A$1:$B$2"), ("Plain", "name", "both", "$C:$C"), ("Plain", "name", "own", "$A$1"),
    }
    rule = found["It's", "conditional_format", None, "E1"]
    assert rule.info == {"type": "cellIs", "priority": "1", "operator": "lessThan", "formula": "0.5"} and (rule.min_row, rule.min_col, rule.max_row, rule.max_col) == (1, 5, 1, 5)
    assert found["It's", "validation", None, "D1:D4"].info == {"type": "whole", "operator": "between", "formula1": "1", "formula2": "9"}
    assert found["It's", "table", "Sales", "A1:C3"].info == {"name": "t_1", "columns": "a\nb"}
    whole = found["Plain", "name", "both", "$C:$C"]
    assert (whole.min_row, whole.min_col, whole.max_row, whole.max_col) == (1, 3, 1_048_576, 3) and found["Plain", "name", "own", "$A$1"].info["scope"] == "Plain"
    assert [tuple(r) for r in read(tmp_path, part="sheets").select("sheet", "sheet_idx", "visible").collect()] == [("It's", 0, True), ("Plain", 1, False)]
    assert {r.kind for r in read(tmp_path, part="objects").filter("sheet = 'Plain'").collect()} == {"name"}


def test_styles_of_cells(read, tmp_path):
    styles = """<numFmts><numFmt numFmtId="170" formatCode="0.00%"/></numFmts><fonts><font/><font><b/><i val="0"/><color rgb="FFFF0000"/></font></fonts>
<fills><fill/><fill><patternFill patternType="solid"><fgColor theme="4"/></patternFill></fill></fills><cellXfs><xf/><xf numFmtId="170" fontId="1" fillId="1"/><xf numFmtId="14"/></cellXfs>"""
    _book(tmp_path / "a.xlsx", {"S": '<sheetData><row r="1"><c r="A1" s="1"/><c r="B1"><v>1</v></c></row><row r="2"><c r="C2" s="2"><v>1</v></c></row></sheetData></worksheet>'}, styles=styles)
    rows = [tuple(r) for r in read(tmp_path, part="styles").drop("file", "sheet", "sheet_idx", "error").collect()]
    assert rows == [(1, 1, "0.00%", True, False, "FFFF0000", "theme 4"), (2, 3, "built-in 14", False, False, None, None)]


def test_unreadable_files_and_wrong_parts(read, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    (tmp_path / "other.txt").write_bytes(b"x")
    for part in workbook_source.PARTS:
        rows = read(tmp_path, part=part).collect()
        assert len(rows) == 1 and rows[0].error and rows[0].file.endswith("bad.xlsx")
    with pytest.raises(Exception, match="part is one of"):
        read(tmp_path, part="none").collect()
    empty = tmp_path / "none"
    empty.mkdir()
    assert read(empty).collect() == []


def test_written_and_read_again(spark, read, tmp_path):
    cells = [("a", "One & 'x'", 0, 2, 1, 1.5, None, None), ("a", "One & 'x'", 0, 1, 28, None, "a<b", None), ("a", "Two", 1, 3, 3, None, None, "=A1&\"<\""), ("b", "One", 0, 1, 1, 2.0, None, None)]
    objects = [("a", "One & 'x'", "merged", None, "A1:B2"), ("a", "One & 'x'", "name", "n1", "$A$1:$B$2"), ("a", "Two", "table", "T", "A1:B9"), ("a", "Two", "table", "U", "D1:E9"), ("b", "One", "validation", '"x,y"', "C1:C5")]
    c = spark.createDataFrame(cells, "file string, sheet string, sheet_idx int, row int, col int, num double, str string, formula string")
    o = spark.createDataFrame(objects, "file string, sheet string, kind string, name string, ref string")
    done = workbook_source.write_workbooks(c, o, f"file://{tmp_path}/out").collect()
    assert sorted(map(tuple, done)) == [("a", 2, 3), ("b", 1, 1)]
    name = F.regexp_extract("file", r"([^/]+)\.xlsx$", 1)
    got = read(f"file://{tmp_path}/out").select(name, "sheet", "sheet_idx", "row", "col", "num", "str", "formula").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in c.select(F.col("file").alias(got[0].__fields__[0]), *c.columns[1:]).collect())
    again = workbook.read_workbooks(spark, f"{tmp_path}/out")
    assert again.count() == 4 and again.filter("error is not null").count() == 0
    found = read(f"file://{tmp_path}/out", part="objects").select(name, "sheet", "kind", "name", "ref").collect()
    want = [(f, s, k, None if k == "validation" else n, r) for f, s, k, n, r in objects]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
