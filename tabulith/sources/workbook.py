"""Workbooks as tables: cells, merged ranges, layout and document properties, one task a file.

Files are read by Spark as bytes, so any store works; sheets are parsed row by row with the standard
library. Only cells that exist are rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_NS = {"m": MAIN, "r": RELATIONS}
#: The built-in number formats that show a date.
DATE_FORMATS = {14, 15, 16, 17, 22}
UNREADABLE = (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ValueError, IndexError, OSError, ElementTree.ParseError)

CELLS = "file string, sheet_index int, sheet string, row int, col int, cell string, value string, kind string, formula string, has_cached boolean, number_format string, style string"
MERGES = "file string, sheet string, row1 int, col1 int, row2 int, col2 int"
LAYOUT = "file string, sheet_index int, sheet string, state string, filter_ref string, freeze string, print_refs array<string>, max_row int, max_col int"
METADATA = "file string, titles array<string>, title string, category string, keywords string, subject string, reason string"


def column_number(ref: str | int) -> int:
    """A column's number from its letters or number; anything else is refused."""
    if isinstance(ref, int) and not isinstance(ref, bool) and ref >= 1:
        return ref
    text = ref.strip().upper() if isinstance(ref, str) else ""
    if not re.fullmatch("[A-Z]{1,3}", text):
        raise ValueError(f"invalid column: {ref!r}")
    n = 0
    for c in text:
        n = 26 * n + ord(c) - 64
    if n > 16_384:
        raise ValueError(f"invalid column: {ref!r}")
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def bounds(ref: str) -> tuple[int, int, int, int]:
    """(row1, col1, row2, col2) of an A1 range or cell, its sheet and dollars aside."""
    m = re.fullmatch(r"([A-Z]{1,3})(\d+)(?::([A-Z]{1,3})(\d+))?", ref.rpartition("!")[2].replace("$", "").upper())
    if not m:
        raise ValueError(f"no bounded range: {ref!r}")
    a, b = (int(m[2]), column_number(m[1])), (int(m[4] or m[2]), column_number(m[3] or m[1]))
    return min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])


@dataclass
class Styles:
    """What the numbers of cell styles mean."""

    formats: list[str] = field(default_factory=list)
    dated: list[bool] = field(default_factory=list)
    digests: list[str] = field(default_factory=list)


def _styles(z: zipfile.ZipFile) -> Styles:
    if "xl/styles.xml" not in z.namelist():
        return Styles()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
    text = lambda e: ElementTree.tostring(e) if e is not None else b""
    fonts, fills = list(root.iterfind("m:fonts/m:font", _NS)), list(root.iterfind("m:fills/m:fill", _NS))
    out = Styles()
    for xf in root.iterfind("m:cellXfs/m:xf", _NS):
        number, font, fill = (int(xf.get(k, 0)) for k in ("numFmtId", "fontId", "fillId"))
        code = own.get(number, "General" if number == 0 else f"builtin:{number}")
        plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(number, ""))
        out.formats.append(code)
        out.dated.append(number in DATE_FORMATS or bool(re.search("[yd]", plain, re.I)))
        out.digests.append(hashlib.sha256(b"|".join([code.encode(), text(fonts[font]) if font < len(fonts) else b"", text(fills[fill]) if fill < len(fills) else b""])).hexdigest())
    return out


@dataclass
class Sheet:
    index: int
    name: str
    part: str
    state: str


class Book:
    """An opened workbook: what its sheets share, and their parts."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        shared = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else ()
        self.shared = ["".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")) for si in shared]
        self.styles = _styles(self.zip)
        self.root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        props = self.root.find("m:workbookPr", _NS)
        self.epoch = date(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else date(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = []
        for k, s in enumerate(self.root.iterfind("m:sheets/m:sheet", _NS)):
            target = targets[s.get(f"{{{RELATIONS}}}id")].lstrip("/")
            self.sheets.append(Sheet(k, s.get("name"), target if target.startswith("xl/") else f"xl/{target}", s.get("state", "visible")))

    def day(self, serial: str) -> str:
        return (self.epoch + timedelta(days=int(float(serial)))).isoformat()

    def cells(self, sheet: Sheet) -> Iterator[tuple[int, int, str, str, str | None, bool, int]]:
        """(row, col, value, kind, formula, has_cached, style) of the cells that exist, row by row.

        kind: n a number, d a number shown as a date (value: ISO), s a text, b, e; empty where there is no value.
        """
        at = 0
        with self.zip.open(sheet.part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                at, col = int(row.get("r", at + 1)), 0
                for c in row.iterfind("m:c", _NS):
                    col = column_number(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else col + 1
                    v, f_ = c.find("m:v", _NS), c.find("m:f", _NS)
                    text, kind, style = "" if v is None else v.text or "", c.get("t", "n"), int(c.get("s", 0))
                    if kind == "s" and text:
                        text = self.shared[int(text)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
                    elif kind == "n" and text and style < len(self.styles.dated) and self.styles.dated[style]:
                        text, kind = self.day(text), "d"
                    kind = {"inlineStr": "s", "str": "s"}.get(kind, kind) if text else ""
                    yield at, col, text, kind, "=" + (f_.text or "") if f_ is not None else None, v is not None and bool(v.text), style
                row.clear()

    def frame(self, sheet: Sheet) -> ElementTree.Element:
        """The sheet's element without its rows."""
        root = None
        with self.zip.open(sheet.part) as f:
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                root = e if root is None else root
                if event == "end" and e.tag == f"{{{MAIN}}}row":
                    e.clear()
        return root

    def layout(self, sheet: Sheet) -> tuple[str | None, str | None, list[str]]:
        """The filter's range, the first cell below frozen panes, and the print area's ranges."""
        root = self.frame(sheet)
        found, pane = root.find("m:autoFilter", _NS), root.find("m:sheetViews/m:sheetView/m:pane", _NS)
        area = ""
        for name in self.root.iterfind("m:definedNames/m:definedName", _NS):
            if name.get("name") == "_xlnm.Print_Area" and name.get("localSheetId") == str(sheet.index):
                area = name.text or ""
        return found.get("ref") if found is not None else None, pane.get("topLeftCell") if pane is not None and pane.get("state", "").startswith("frozen") else None, re.findall(r"(?:'(?:[^']|'')*'|[^,'])+", area)

    def properties(self) -> dict[str, str]:
        if "docProps/core.xml" not in self.zip.namelist():
            return {}
        return {e.tag.rpartition("}")[2]: e.text or "" for e in ElementTree.fromstring(self.zip.read("docProps/core.xml"))}


def _each(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """rows(name, book or None, error) of every workbook below a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = raw.where("lower(path) like '%.xlsx' or lower(path) like '%.xlsm' or lower(path) like '%.xltx' or lower(path) like '%.xltm'")
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                held: list[tuple] = []
                try:
                    for row in rows(name, Book(content), None):
                        held.append(row)
                        if len(held) >= 10_000:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                except UNREADABLE as e:
                    held += list(rows(name, None, type(e).__name__))
                if held:
                    yield pd.DataFrame(held, columns=names)

    return raw.select("path", "content").mapInPandas(read, schema)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of every workbook below a path, formulas and cached values apart, with formats and style digests."""

    def rows(name: str, book: Book | None, error: str | None) -> Iterator[tuple]:
        for sheet in book.sheets if book else ():
            for r, c, value, kind, formula, cached, s in book.cells(sheet):
                known = s < len(book.styles.formats)
                yield name, sheet.index, sheet.name, r, c, f"{column_letters(c)}{r}", value, kind, formula, cached, book.styles.formats[s] if known else "General", book.styles.digests[s] if known else ""

    return _each(spark, path, CELLS, rows)


def merges(spark: SparkSession, path: str) -> DataFrame:
    """The merged ranges of every workbook below a path."""

    def rows(name: str, book: Book | None, error: str | None) -> Iterator[tuple]:
        for sheet in book.sheets if book else ():
            for m in book.frame(sheet).iterfind("m:mergeCells/m:mergeCell", _NS):
                yield name, sheet.name, *bounds(m.get("ref"))

    return _each(spark, path, MERGES, rows)


def layout(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sheet: its filter, frozen panes, print area and used extent."""

    def rows(name: str, book: Book | None, error: str | None) -> Iterator[tuple]:
        for sheet in book.sheets if book else ():
            last = [0, 0]
            for r, c, value, *_ in book.cells(sheet):
                last = [max(last[0], r), max(last[1], c)]
            yield name, sheet.index, sheet.name, sheet.state, *book.layout(sheet), *last

    return _each(spark, path, LAYOUT, rows)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each workbook: sheet titles and four document properties, or why it could not be read."""

    def rows(name: str, book: Book | None, error: str | None) -> Iterator[tuple]:
        p = book.properties() if book else {}
        yield name, [s.name for s in book.sheets] if book else [], *[p.get(k, "") for k in ("title", "category", "keywords", "subject")], error

    return _each(spark, path, METADATA, rows)


def uncached_formulas(cells_: DataFrame) -> DataFrame:
    """Cells whose formula has no stored value: what reads values only would take them for empty."""
    return cells_.where("formula is not null and not has_cached").select("file", "sheet", "cell")
