"""Workbooks as rows of cells."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tombola.operators import parse
from tombola.plans import landed
from tombola.sources import sheets

MAIN = landed._MAIN


def workbook(rows: str, *, strings: str = "", styles: str | None = None, book: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in landed._PARTS.items():
            part = styles if styles is not None and name == "xl/styles.xml" else part
            z.writestr(name, book if book is not None and name == "xl/workbook.xml" else part)
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def read(content: bytes, width: int = 3):
    return [(n, [c and (c["kind"], c["text"]) for c in cells]) for n, cells in sheets.sheet_rows(content, width)]


def test_kinds_of_cells():
    strings = "<si><t>a &amp; b</t></si><si><r><t>c</t></r><r><t xml:space='preserve'> d</t></r><rPh sb='0' eb='1'><t>no</t></rPh></si>"
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>e</t></is></c></row>'
    rows += '<row r="4"><c r="B4"><v>1.5</v></c><c r="C4" t="b"><v>1</v></c><c r="AB4"><v>9</v></c></row>'
    rows += '<row><c><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>=x</v></c></row><row r="9"/>'
    assert read(workbook(rows, strings=strings)) == [
        (1, [("text", "a & b"), ("text", "c d"), ("text", "e")]),
        (4, [None, ("number", "1.5"), ("boolean", "1")]),
        (5, [("number", "1"), ("error", "#N/A"), ("text", "=x")]),
        (9, [None, None, None]),
    ]


def test_dates_are_numbers_with_a_style():
    styles = f"""<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="dd\\/mm"/><numFmt numFmtId="165" formatCode='0 "days"'/></numFmts>
      <cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>"""
    rows = '<row r="1"><c r="A1" s="1"><v>43831</v></c><c r="B1" s="2"><v>43831</v></c><c r="C1" s="1"><v>43831.75</v></c></row>'
    rows += '<row r="2"><c r="A2" s="1"><v>59</v></c><c r="B2" s="1"><v>61</v></c><c r="C2" s="1"><v>1e99</v></c></row>'
    assert read(workbook(rows, styles=styles)) == [
        (1, [("date", "2020-01-01"), ("number", "43831"), ("date", "2020-01-01 18:00:00")]),
        (2, [("date", "1900-02-28"), ("date", "1900-03-01"), ("number", "1e99")]),
    ]
    book = landed._PARTS["xl/workbook.xml"].replace("<sheets>", '<workbookPr date1904="1"/><sheets>')
    assert read(workbook('<row r="1"><c r="A1" s="1"><v>42369</v></c></row>', book=book), 1) == [(1, [("date", "2020-01-01")])]


def test_long_sheets_come_in_batches_and_bad_files_leave_the_others(spark, tmp_path):
    n = 2 * sheets.BATCH + 1
    (tmp_path / "long.xlsx").write_bytes(workbook("".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(1, n + 1))))
    (tmp_path / "empty.xlsx").write_bytes(workbook(""))
    (tmp_path / "bad.xlsx").write_bytes(b"none")
    cut = workbook('<row r="1"><c r="A1" t="s"><v>7</v></c></row>')
    (tmp_path / "lost.xlsx").write_bytes(cut)  # a string that isn't there
    (tmp_path / "other.txt").write_text("not asked for")
    out = sheets.read_sheets(spark, str(tmp_path))
    good = out.where("error IS NULL")
    assert good.agg(F.count("*"), F.sum("row"), F.sum(F.get("cells", F.lit(0))["text"].cast("long"))).head()[:] == (n, n * (n + 1) // 2, n * (n + 1) // 2)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in out.where("error IS NOT NULL").collect()) == ["bad.xlsx", "lost.xlsx"]
    none = spark.createDataFrame([("p", None)], "path string, content binary")
    assert sheets.sheet_cells(none).head()["error"].startswith("BadZipFile")


def test_records_of_landed_workbooks(spark, tmp_path):
    row = lambda k, day, name="gana": f'<row r="{k}">{day}<c r="C{k}"><v>100</v></c><c r="D{k}"><v>7.9</v></c><c r="E{k}"><v>3</v></c><c r="F{k}" t="inlineStr"><is><t> {name} </t></is></c></row>'
    dated, said = '<c r="B{0}" s="1"><v>43831</v></c>', '<c r="B{0}" t="inlineStr"><is><t>2020-01-01</t></is></c>'
    for k, text in enumerate((row(1, dated.format(1)) + row(2, said.format(2)), row(1, dated.format(1), "no"))):
        (tmp_path / f"{k}.xlsx").write_bytes(workbook(text))
    cells = sheets.as_spreadsheet(sheets.read_sheets(spark, str(tmp_path)))
    rows = parse.from_spreadsheet(cells, (("GANA", "L", "Gana"),), today=F.lit("2025-01-01").cast("date"), source="s").collect()
    assert [(r["lottery"], r["draw_date"], r["numbers"]) for r in rows] == [("L", date(2020, 1, 1), [0, 7, 3])]


@pytest.mark.parametrize("content", [b"", b"PK"])
def test_what_is_no_workbook(content):
    with pytest.raises(zipfile.BadZipFile):
        read(content)
