"""Workbooks without any library for them: made from the format's parts, and read in tasks."""

import datetime
import zipfile

import pytest

from quietlake.sources import files, workbooks

SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _book(path, sheets: dict[str, str], strings=(), about=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {SPACE}><workbookPr {about}/><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {SPACE}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {SPACE}><numFmts><numFmt numFmtId="200" formatCode="yyyy&quot;年&quot;m"/><numFmt numFmtId="201" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="200"/><xf numFmtId="201"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {SPACE}><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


HEAD = '<row r="2">' + "".join(f'<c r="{c}2" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABCDEFG", ["name", "n", "x", "ok", "day", "month", "name"], strict=True)) + "</row>"
ROWS = (
    '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3"><v>3</v></c><c r="C3"><v>1.5</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" s="1"><v>45292</v></c><c r="F3" s="2"><v>45292.25</v></c><c r="G3" s="3"><v>2</v></c></row>'
    '<row r="4"><c r="A4" t="s"><v>1</v></c><c r="C4"><v>2</v></c><c r="D4" t="e"><v>#N/A</v></c><c r="G4" t="str"><f>A4</f><v>x</v></c></row>'
    '<row r="6"><c><v>7</v></c><c><v>1E3</v></c></row>'
)
STRINGS = ["<r><t>高橋 </t></r><r><t>美咲</t></r>", "<t>a &lt; b</t>"]


def test_a_sheet_is_a_table(spark, tmp_path):
    path = _book(tmp_path / "b.xlsx", {"first": HEAD + ROWS, "second": '<row><c t="inlineStr"><is><t>q</t></is></c></row><row><c><v>1</v></c></row>', "empty": ""}, STRINGS)
    table = files.load(spark, path)
    assert table.dtypes == [("name", "string"), ("n", "bigint"), ("x", "double"), ("ok", "boolean"), ("day", "timestamp_ntz"), ("month", "timestamp_ntz"), ("name_6", "string")]
    rows = [tuple(r) for r in table.collect()]
    assert rows[0] == ("高橋 美咲", 3, 1.5, True, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 6), "2")
    assert rows[1] == ("a < b", None, 2.0, None, None, None, "x") and rows[2] == ("7", 1000, None, None, None, None, None)
    assert workbooks.sheet_names(spark, path) == ["first", "second", "empty"]
    assert files.load(spark, path, sheet_name="second").collect()[0]["q"] == files.load(spark, path, sheet_name=1).collect()[0]["q"] == 1
    assert files.load(spark, path, sheet_name="empty").columns == []
    with pytest.raises(ValueError, match="unsupported"):
        files.load(spark, str(tmp_path / "old.xls"))


def test_the_other_calendar_and_many_rows(spark, tmp_path):
    rows = '<row><c t="inlineStr"><is><t>d</t></is></c><c t="inlineStr"><is><t>i</t></is></c></row>' + "".join(f'<row><c s="1"><v>{i}</v></c><c><v>{i}</v></c></row>' for i in range(2000))
    table = files.load(spark, _book(tmp_path / "c.xlsx", {"s": rows}, about='date1904="1"'))
    assert table.count() == 2000 and table.selectExpr("min(d) as low", "sum(i) as total").first() == (datetime.datetime(1904, 1, 1), 1999 * 1000)


def test_an_analysis_of_a_workbook_is_guarded(spark, tmp_path):
    from quietlake.config import Settings
    from quietlake.engine import Engine

    _book(tmp_path / "people.xlsx", {"s": HEAD + ROWS}, STRINGS)
    engine = Engine(spark, {}, Settings(inbox=str(tmp_path)))
    fid = files.file_id("people.xlsx")
    assert engine.run_analysis(lambda d: d.load(fid).agg({"x": "sum"}).first()[0], [fid])["result"] == 3.5
    assert "protected" in engine.run_analysis(lambda d: d.load(fid).first()["name"], [fid])["error"]
