"""Spreadsheets (Office Open XML workbooks) as rows of cells.

Files land as Spark's binaryFile rows, so listing, splits and remote paths are
Spark's; a task opens one file after another, reads the first sheet as a stream of
rows and hands them on in batches. What a task holds is a file's compressed content
(2 GB at most, as binaryFile has it) and its shared strings.

A cell is its kind and text. Dates are numbers with a date's style: their kind is
date, their text ISO. A file that is no workbook is one row with its error; what was read
before the error stays, and so do other files' rows. Null content is such an error; a sheet without rows gives none; cells
that aren't written are null."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from posixpath import join, normpath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a batch.
BATCH = 4096
#: The numbers of built-in formats that show a date.
DATE_FORMATS = {14, 15, 16, 17, 22}

#: What reading a file that is damaged, locked or none at all raises.
BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, ValueError, LookupError, RuntimeError)

CELLS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
_OUT = pa.schema([("path", pa.string()), ("row", pa.int64()), ("cells", CELLS), ("error", pa.string())])
_SCHEMA = "path string, row long, cells array<struct<kind: string, text: string>>, error string"

Cell = dict[str, str] | None


def _bare(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, part: str, wanted: str) -> Iterator[ElementTree.Element]:
    """A part's elements of one name, one at a time; none if there is no such part."""
    if part not in book.namelist():
        return
    with book.open(part) as stream:
        above: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if _bare(element.tag) == wanted:
                yield element
                if above:  # let go of what has been read
                    above[-1].clear()


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _bare(k) == name), None)


def _said(element: ElementTree.Element) -> str:
    """A string's runs, without readings beside them."""
    return "".join((x.text or "") if _bare(x.tag) == "t" else _said(x) for x in element if _bare(x.tag) in ("t", "r"))


def _shows_date(code: str) -> bool:
    """Whether a format has days or years outside quotes, brackets and escapes."""
    return re.search("[dDyY]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)) is not None


def _dated_styles(book: zipfile.ZipFile) -> set[int]:
    own = {int(_attribute(e, "numFmtId")): _shows_date(_attribute(e, "formatCode") or "") for e in _elements(book, "xl/styles.xml", "numFmt")}
    formats = [int(_attribute(x, "numFmtId") or 0) for e in _elements(book, "xl/styles.xml", "cellXfs") for x in e]
    return {k for k, f in enumerate(formats) if own.get(f, f in DATE_FORMATS)}


def _first_sheet(book: zipfile.ZipFile) -> str:
    first = next(_elements(book, "xl/workbook.xml", "sheet"), None)
    if first is None:
        raise ValueError("a workbook without sheets")
    # Its id is the attribute of another namespace than sheetId's.
    wanted = next((v for k, v in first.attrib.items() if k.endswith("}id")), None)
    for related in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship"):
        if _attribute(related, "Id") == wanted:
            return normpath(join("/xl", _attribute(related, "Target") or "")).lstrip("/")
    raise ValueError("a workbook that doesn't say where its first sheet is")


def _day(serial: str, since_1904: bool) -> str | None:
    """Days are counted from 1904 or from 1900, which this format takes for a leap year."""
    try:
        days = float(serial)
        first = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30 if days >= 60 else 31)
        day = first + timedelta(seconds=round(days * 86400))
    except (ValueError, OverflowError):
        return None
    return day.isoformat(sep=" ").removesuffix(" 00:00:00")


def _column(reference: str) -> int:
    """The place of a cell like AB12, from 0."""
    n = 0
    for letter in reference.rstrip("0123456789"):
        n = 26 * n + ord(letter) - 64
    return n - 1


def sheet_rows(content: bytes, width: int) -> Iterator[tuple[int, list[Cell]]]:
    """The number and first `width` cells of each row of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheet = _first_sheet(book)
        if sheet not in book.namelist():
            raise ValueError(f"a workbook without its {sheet}")
        since_1904 = any(_attribute(e, "date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", "workbookPr"))
        dated = _dated_styles(book)
        shared = [_said(e) for e in _elements(book, "xl/sharedStrings.xml", "si")]

        def cell(c: ElementTree.Element) -> Cell:
            kind, parts = c.get("t", "n"), {_bare(x.tag): x for x in c}
            if kind == "inlineStr":
                return {"kind": "text", "text": _said(parts["is"])} if "is" in parts else None
            value = parts["v"].text if "v" in parts else None
            if value is None:
                return None
            if kind == "n":
                day = _day(value, since_1904) if int(c.get("s", 0)) in dated else None
                return {"kind": "date", "text": day} if day else {"kind": "number", "text": value}
            if kind == "s":
                return {"kind": "text", "text": shared[int(value)]}
            names = {"d": "date", "b": "boolean", "e": "error"}
            return {"kind": names.get(kind, "text"), "text": value.replace("T", " ") if kind == "d" else value}

        at = 0
        for row in _elements(book, sheet, "row"):
            at = int(row.get("r", at + 1))
            cells: list[Cell] = [None] * width
            place = -1
            for c in row:
                place = _column(c.get("r")) if c.get("r") else place + 1
                if place >= width:
                    break
                cells[place] = cell(c)
            yield at, cells


def _batch(path: str | None, rows: list[tuple[int | None, list[Cell] | None]], error: str | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path] * len(rows), "row": [r[0] for r in rows], "cells": [r[1] for r in rows], "error": [error] * len(rows)}, _OUT)


def sheet_cells(files: DataFrame, width: int = 6) -> DataFrame:
    """path, row, cells (of the first `width` columns), error: the rows of all
    `files` (path and content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held: list[tuple[int, list[Cell]]] = []
                try:
                    for row in sheet_rows(content.as_py() or b"", width):
                        held.append(row)
                        if len(held) == BATCH:
                            yield _batch(path.as_py(), held)
                            held = []
                except BROKEN as e:
                    yield _batch(path.as_py(), [(None, None)], f"{type(e).__name__}: {e}")
                yield _batch(path.as_py(), held)

    return files.select("path", "content").mapInArrow(read, _SCHEMA)


def read_sheets(spark: SparkSession, path: str, width: int = 6, pattern: str = "*.xlsx") -> DataFrame:
    """The cells of all workbooks in a folder, or of one."""
    return sheet_cells(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path), width)


def as_spreadsheet(rows: DataFrame) -> DataFrame:
    """c0 to c5 for `parse.from_spreadsheet`. A date has to be one: text that looks
    like a date is none."""
    at = lambda k: F.get("cells", F.lit(k))
    text = [F.when(at(k)["kind"] == "date", at(k)["text"]) if k == 1 else at(k)["text"] for k in range(6)]
    return rows.where("error IS NULL").select(*[c.alias(f"c{k}") for k, c in enumerate(text)])
