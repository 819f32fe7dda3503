"""Landed pages, texts and cells made from the test tables, so that parsers and
jobs have whole tables to run over: each order is written down as a page says
it, and what is read back is known."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parse, reconcile
from ..sources.history import from_feed
from ..sources.schema import Dims
from ..sources.sheets import as_spreadsheet, sheet_cells

SLUGS = (("urgent", "1-URGENT"), ("high", "2-HIGH"), ("medium", "3-MEDIUM"), ("not-specified", "4-NOT SPECIFIED"), ("low", "5-LOW"))
NAMES = ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW")
WANTED = (("1-urgent", "f", "Urgent", "Early"), ("1-urgent", "o", "Urgent", "Late"), ("3-medium", "p", "Medium", "Other"))
SHEET_NAMES = (("F", "Sheet", "Early"), ("O", "Sheet", "Late"))


def _n(k: int) -> Column:
    return T.pad2(F.get("numbers", F.lit(k)))


def _slug() -> Column:
    return F.lower(F.replace(F.substring("lottery", 3, 100), F.lit(" "), F.lit("-")))


def _day(form: str) -> Column:
    return F.date_format("draw_date", form)


def _long_day() -> Column:
    return F.concat(_day("d"), F.lit(" de "), F.element_at(F.array(*[F.lit(m) for m in T.MONTHS]), F.month("draw_date")), F.lit(" de "), _day("yyyy"))


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("lottery", "draw", "draw_date", *[F.get("numbers", F.lit(k)).alias(f"n{k + 1}") for k in range(3)])


def block_pages(rows: DataFrame, own_day: Column) -> DataFrame:
    """html and page_date; own_day: what the block says of its date."""
    scores = [x for k in range(3) for x in ('<span class="score ">', _n(k), "</span> ")]
    html = _said('<p>Junk 9-9 <div class="game-block past"><div><span class="day">', own_day, '</span> <a class="game-title" href="/x/', _slug(), '/y"> <span>', F.col("draw"), "</span> </a></div> <div>", *scores, "</div> </div> </div> <p>8-8")
    return rows.select(html.alias("html"), "page_date")


def blocks(rows: DataFrame) -> DataFrame:
    """Every second block has a date of its own, in the page's year."""
    rows = rows.withColumn("page_date", F.date_add("draw_date", (F.col("seq") % 3).cast("int")))
    return _flat(parse.from_block_page(block_pages(rows, F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(_day("dd-MM"))), SLUGS))


def lists(rows: DataFrame) -> DataFrame:
    html = _said("<h2>x</h2><h3><a href='/", _slug(), "/z' class='c'>", F.col("draw"), "</a></h3>\n<p><span>", _n(0), "</span> <span>", _n(1), "</span> <i>", _n(2), "</i></p><div><span class='lotdate'>Jueves ", _long_day(), "</span></div>")
    return _flat(parse.from_list_page(rows.select(html.alias("html")), SLUGS))


def attributes(rows: DataFrame) -> DataFrame:
    html = _said('<a href="/none">x</a> <a href="/', _slug(), '" class="b" data-loteria-nombre="', F.col("draw"), '" data-loteria-fecha="', _day("d-M-yyyy"), '" data-loteria-numeros="', _n(0), ", ", _n(1), ", ", _n(2), '">y</a>')
    return _flat(parse.from_attribute_page(rows.select(html.alias("html")), SLUGS))


def tables(rows: DataFrame) -> DataFrame:
    html = _said("<tr><th>Fecha</th></tr><tr class='r'><td>", _day("d/M/yyyy"), "</td><td>", F.col("draw"), " noche</td><td>", _n(0), " - ", _n(1), " <b>", _n(2), "</b></td></tr>")
    return _flat(parse.from_table_page(rows.select(html.alias("html"), "lottery"), (("p noche", "5-LOW"),)))


def texts(rows: DataFrame) -> DataFrame:
    """Pages by their text parts: a known name, then session, date and numbers."""
    html = _said("<script>7 | 8</script><p>menu</p><div>", F.substring("lottery", 3, 100), "</div><td>Sorteo ", F.when(F.col("seq") % 2 == 0, "Noche").otherwise("Tarde"), "</td><td>", _day("dd/MM/yyyy"), "</td><b>", _n(0), " ", _n(1), " ", _n(2), "</b><i>pie</i>")
    pages = rows.select(parse.page_text(html).alias("text"))
    return _flat(parse.from_text(pages, NAMES, today=F.lit("1990-01-01").cast("date")))


def sheets(rows: DataFrame) -> DataFrame:
    """100 stands for 0, fractions are cut off, every seventh row has a bad cell."""
    cell = F.when((F.get("numbers", F.lit(0)) == 0) & (F.col("seq") % 2 == 0), F.lit("100")).otherwise(F.get("numbers", F.lit(0)).cast("string"))
    cells = rows.select(
        F.lit("").alias("c0"), _day("yyyy-MM-dd").alias("c1"), cell.alias("c2"), F.concat(F.get("numbers", F.lit(1)).cast("string"), F.lit(".9")).alias("c3"),
        F.when(F.col("seq") % 7 == 0, F.lit("x")).otherwise(F.get("numbers", F.lit(2)).cast("string")).alias("c4"), F.concat(F.lit(" "), F.lower("draw"), F.lit(" ")).alias("c5"),
    )
    return _flat(parse.from_spreadsheet(cells, SHEET_NAMES, today=F.lit("1999-12-31").cast("date"), source="sheet"))


#: The parts of a workbook that a reader needs, and their names.
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PARTS = {
    "xl/workbook.xml": f'<workbook {_MAIN} xmlns:r="{_RELATED}"><sheets><sheet name="Draws" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_RELATED}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet {_MAIN}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
}


def _workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One workbook a batch: dates as numbers with a date's style, as ISO dates, or
    (every fifth row) as text; numbers as such, in the last place as shared strings."""
    for batch in batches:
        shared: dict[str, int] = {}
        said = []
        for k, (seq, serial, iso, n1, n2, n3, draw) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
            day = f'<c r="B{k}" s="1"><v>{serial}</v></c>' if seq % 2 else f'<c r="B{k}" s="1" t="d"><v>{iso}</v></c>'
            day = day if seq % 5 else f'<c r="B{k}" t="inlineStr"><is><t>{iso}</t></is></c>'
            last = shared.setdefault("x" if seq % 7 == 0 else str(n3), len(shared))
            first = 100 if n1 == 0 and seq % 2 == 0 else n1
            said.append(f'<row r="{k}">{day}<c r="C{k}"><v>{first}</v></c><c r="D{k}"><v>{n2}.9</v></c><c r="E{k}" t="s"><v>{last}</v></c><c r="F{k}" t="inlineStr"><is><t> {draw} </t></is></c></row>')
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for name, part in _PARTS.items():
                book.writestr(name, part)
            book.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{''.join(f'<si><t>{x}</t></si>' for x in shared)}</sst>")
            book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData>{''.join(said)}</sheetData></worksheet>")
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([out.getvalue()])], ["path", "content"])


def workbooks(rows: DataFrame) -> DataFrame:
    """path and content of workbooks that hold all rows, as binary files land."""
    serial = F.datediff("draw_date", F.lit("1899-12-30").cast("date"))
    cells = rows.select("seq", serial.alias("serial"), _day("yyyy-MM-dd").alias("iso"), *[F.get("numbers", F.lit(k)).alias(f"n{k}") for k in range(3)], F.lower("draw").alias("draw"))
    return cells.mapInArrow(_workbooks, "path string, content binary")


def sheet_files(rows: DataFrame) -> DataFrame:
    cells = as_spreadsheet(sheet_cells(workbooks(rows)))
    return _flat(parse.from_spreadsheet(cells, SHEET_NAMES, today=F.lit("1999-12-31").cast("date"), source="sheet"))


def feed(rows: DataFrame) -> DataFrame:
    """Empty names get defaults; what isn't made of digits is no number."""
    said = F.concat(F.transform("numbers", lambda n: n.cast("string")), F.array(F.lit("x1"), F.lit("")))
    answers = rows.select(
        F.when(F.col("seq") % 11 == 0, F.lit("")).otherwise(F.col("lottery")).alias("loteria"), F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.col("draw")).alias("juego"),
        F.when(F.col("seq") % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("t"), "draw")).alias("turno"), F.when(F.col("seq") % 13 == 0, F.lit("")).otherwise(_day("yyyy-MM-dd")).alias("fecha"), said.alias("numeros"),
    )
    return _flat(from_feed(answers, "feed"))


def wanted(rows: DataFrame) -> DataFrame:
    return _flat(parse.wanted(rows, WANTED))


def dates(rows: DataFrame) -> DataFrame:
    """Dates in every form, one that is none before another, and none."""
    kind = F.col("seq") % 6
    said = F.when(kind == 0, _said("el ", _day("d/M/yyyy"), " y 7")).when(kind == 1, _said("x ", _day("d-M-yy"))).when(kind == 2, _said(_day("yyyy-M-d"), "."))
    said = said.when(kind == 3, _said("31/02/2024 y ", _day("d/M/yyyy"))).when(kind == 4, _said("1", _day("dd/MM/yyyy"), "5 none")).otherwise(_said("Lunes <b>", _long_day(), "</b>"))
    return rows.select("seq", T.bound(said, lambda x: F.struct(T.date_in(x).alias("day"), T.date_or_long_date_in(x).alias("any_day"))).alias("found")).select("seq", "found.*")


def repairs(rows: DataFrame) -> DataFrame:
    """Damaged text, damage beyond repair, and sound text."""
    damaged = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    kind, number = F.col("seq") % 4, F.col("seq").cast("string")
    said = F.when(kind == 0, damaged(_said("Lotería  ", number))).when(kind == 1, damaged(_said("<b>SEÑAL</b> ", number))).when(kind == 2, _said("Ã broken ", number)).otherwise(_said(" Plain É ", number))
    return rows.select("seq", T.bound(said, lambda x: F.struct(T.repaired(x).alias("repaired"), T.clean(x).alias("clean"), T.normalized(x).alias("normal"))).alias("found")).select("seq", "found.*")


def small_functions(rows: DataFrame) -> DataFrame:
    """Sessions, short dates, months of an archive page, names by path or draw."""
    session = F.element_at(F.array(*[F.lit(x) for x in ("de la NOCHE y tarde", "Tarde", "matutino", "medio dia", "otro")]), (F.col("seq") % 5 + 1).cast("int"))
    options = _said('<option value="', _day("yyyy-MM"), '">a<option value="1990-05"><option value="2010-01">b<option value="', _day("yyyy-MM"), '">')
    path = F.when(F.col("seq") % 2 == 0, _said("/", _slug(), "?a")).otherwise(F.lit("/none"))
    return rows.select(
        "seq", T.session_of(session).alias("session"), T.short_date(_day("yyyy-MM-dd")).alias("short"), F.array_join(parse.months_in(options, 1996), " ").alias("months"),
        T.lottery_of_path_or_draw(path, F.when(F.col("seq") % 3 == 0, F.lit("Not  specified")).otherwise(F.col("draw")), SLUGS).alias("lottery"),
        T.script_safe_json(F.struct(F.concat(F.lit("</b>"), "draw").alias("a"))).alias("json"),
    )


def daily_job(there: DataFrame, comes: DataFrame, job: Callable[[DataFrame, DataFrame, Dims], DataFrame], dims: Dims) -> DataFrame:
    """The job with a history and with the pages of what comes, one a slot."""
    new = reconcile.dedupe(comes, dims.ranks).withColumn("page_date", F.col("draw_date"))
    dims = Dims(start=dims.start, ranks=(("blocks", 1), *dims.ranks), slugs=SLUGS)
    return job(there, block_pages(new, F.lit("")), dims).select("lottery", "draw", "draw_date", "source", *[F.get("numbers", F.lit(k)).alias(f"n{k + 1}") for k in range(3)])


def backfill_job(there: DataFrame, comes: DataFrame, job: Callable[..., DataFrame], dims: Dims) -> DataFrame:
    """The job with a history, block pages of one half of what comes and monthly
    tables of the other, one row a slot in each."""
    halves = [reconcile.dedupe(comes.where(F.col("seq") % 4 == k), dims.ranks) for k in (1, 3)]
    html = _said("<tr><td>", _day("d/M/yyyy"), "</td><td>", F.col("draw"), "</td><td>", _n(0), " ", _n(1), " ", _n(2), "</td></tr>")
    pages = block_pages(halves[0].withColumn("page_date", F.col("draw_date")), F.lit(""))
    dims = Dims(start=dims.start, ranks=(("blocks", 1), ("table", 2), *dims.ranks), slugs=SLUGS)
    return _flat(job(there, pages, halves[1].select(html.alias("html"), "lottery"), dims, ()))


def gap_fill_job(there: DataFrame, comes: DataFrame, job: Callable[..., DataFrame], dims: Dims) -> DataFrame:
    """The job with a history, and block pages of what comes, one row a slot."""
    new = reconcile.dedupe(comes, dims.ranks).withColumn("page_date", F.col("draw_date"))
    dims = Dims(start=dims.start, ranks=(("blocks", 1), *dims.ranks), slugs=SLUGS)
    return _flat(job(there, block_pages(new, F.lit("")), "1995-01-01", "2001-12-31", ("Urgent",), WANTED, dims))


def initials(rows: DataFrame) -> DataFrame:
    return rows.select("seq", T.initials(F.when(F.col("seq") % 5 > 0, F.concat(F.lit("Lotería "), "lottery")).otherwise(" Lotería ")).alias("initials"))
