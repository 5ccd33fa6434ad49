"""Workbooks (XLSX, ODS): one table a sheet, cells typed by the file.

The driver reads a workbook's list of sheets only. A sheet is bounded by its format, 1,048,576 rows; one task reads it row
by row and writes its cells as text with their kinds, from which the table is made."""

from __future__ import annotations

import datetime as dt
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.engine.session import Scratch
from millrace.sources import delimited, names

MAX_ENTRIES, MAX_RATIO, RATIO_FROM = 100_000, 200, 256 << 20
MAX_SHEET_ROWS, MAX_SHEET_COLUMNS = 1_048_576, 16_384
_N = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
#: Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47, *range(27, 37), *range(50, 59)}


def opened(path: str) -> zipfile.ZipFile:
    """The archive, refused when it unpacks to far more than it holds."""
    z = zipfile.ZipFile(path)
    infos = z.infolist()
    if len(infos) > MAX_ENTRIES:
        raise ValueError("the archive has too many entries")
    for i in infos:
        if i.file_size > RATIO_FROM and i.file_size > MAX_RATIO * max(1, i.compress_size):
            raise ValueError("the archive unpacks to far more than it holds")
    return z


def _serial(x: float, base1904: bool):
    days = dt.datetime(1904, 1, 1) if base1904 else dt.datetime(1899, 12, 30)
    t = days + dt.timedelta(seconds=round(x * 86400))
    return t.date() if t.time() == dt.time(0) and x == int(x) else t


def _number(x: float):
    return int(x) if x == int(x) and abs(x) < 2**63 else x


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _book(z: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """((sheet, its part of the archive) in order, whether dates count from 1904)."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    pr = book.find(f"{_N}workbookPr")
    rels = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    parts = [(s.get("name"), rels[s.get(f"{_R}id")]) for s in book.iter(f"{_N}sheet")]
    return [(n, p if p.startswith("xl/") else f"xl/{p}") for n, p in parts], pr is not None and pr.get("date1904") in ("1", "true")


def sheets(path: str) -> list[str]:
    """The names of a workbook's sheets, in order."""
    with opened(path) as z:
        if "xl/workbook.xml" in z.namelist():
            return [n for n, _ in _book(z)[0]]
        with z.open("content.xml") as f:
            return [e.get(f"{_T}name") for event, e in ET.iterparse(f, ("start",)) if e.tag == f"{_T}table"]


def _ended(f, *tags: str) -> Iterator[ET.Element]:
    """Elements as they end; what has been given is dropped, so that a part of any size is read in little memory."""
    for _, e in ET.iterparse(f, ("end",)):
        if e.tag in tags:
            yield e
            e.clear()


def xlsx_rows(path: str, sheet: str) -> Iterator[list]:
    """Rows of cells of a sheet; an error cell is null."""
    with opened(path) as z:
        shared, dates = [], set()
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(f"{_N}t")) for si in _ended(f, f"{_N}si")]
        if "xl/styles.xml" in z.namelist():
            styles = ET.fromstring(z.read("xl/styles.xml"))
            custom = {int(f.get("numFmtId")) for f in styles.iter(f"{_N}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower())}
            xfs = styles.find(f"{_N}cellXfs")
            dates = {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | custom}
        parts, base1904 = _book(z)
        with z.open(dict(parts)[sheet]) as f:
            for row in _ended(f, f"{_N}row"):
                cells: list = []
                for c in row.iter(f"{_N}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    if at >= MAX_SHEET_COLUMNS:
                        raise ValueError("the sheet has too many columns")
                    cells += [None] * (at - len(cells))
                    v, kind = c.findtext(f"{_N}v"), c.get("t", "n")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_N}t"))
                    elif v is None or kind == "e":
                        value = None
                    elif kind == "s":
                        value = shared[int(v)]
                    elif kind == "b":
                        value = v == "1"
                    elif kind in ("str", "d"):
                        value = v
                    else:
                        value = _serial(float(v), base1904) if int(c.get("s", 0)) in dates else _number(float(v))
                    cells.append(value)
                yield cells


def ods_rows(path: str, sheet: str) -> Iterator[list]:
    """Rows of cells of a sheet; repeated rows and cells are spread where they hold anything."""
    with opened(path) as z, z.open("content.xml") as f:
        inside, given = False, 0
        for event, e in ET.iterparse(f, ("start", "end")):
            if e.tag == f"{_T}table":
                inside = event == "start" and e.get(f"{_T}name") == sheet
            if event != "end" or e.tag != f"{_T}table-row":
                continue
            if inside:
                cells: list = []
                for c in e:
                    if c.tag not in (f"{_T}table-cell", f"{_T}covered-table-cell"):
                        continue
                    v, n = _ods_cell(c), int(c.get(f"{_T}number-columns-repeated", 1))
                    if v is None:
                        cells += [None] * min(n, MAX_SHEET_COLUMNS - len(cells))
                    elif len(cells) + n > MAX_SHEET_COLUMNS:
                        raise ValueError("the sheet has too many columns")
                    else:
                        cells += [v] * n
                while cells and cells[-1] is None:
                    cells.pop()
                n = int(e.get(f"{_T}number-rows-repeated", 1)) if cells else 1
                given += n
                if cells and given > MAX_SHEET_ROWS:
                    raise ValueError("the sheet has too many rows")
                for _ in range(n):
                    yield cells
            e.clear()


def _ods_cell(c: ET.Element):
    kind = c.get(f"{_O}value-type")
    if kind in ("float", "percentage", "currency"):
        return _number(float(c.get(f"{_O}value")))
    if kind == "boolean":
        return c.get(f"{_O}boolean-value") == "true"
    if kind == "date":
        raw = c.get(f"{_O}date-value")
        return dt.datetime.fromisoformat(raw) if "T" in raw else dt.date.fromisoformat(raw)
    return "\n".join("".join(p.itertext()) for p in c.iter(f"{_X}p")) or None


def _shown(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return str(v).lower() if isinstance(v, bool) else v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else repr(v)


_KINDS = {bool: "b", int: "i", float: "f", dt.date: "d", dt.datetime: "t", str: "s"}


def _kind(v) -> str:
    return "" if v is None else _KINDS[type(v)]


def read(spark: SparkSession, path: str, sheet: str, header: bool | None = None) -> DataFrame:
    """A sheet as a table: blank rows are dropped, the header found as for delimited text, unlike cells of a column become
    text. An empty sheet is a table without columns."""
    rows_of = ods_rows if path.lower().endswith(".ods") else xlsx_rows

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _ in range(len(b)):
                held = []
                for i, r in enumerate(rows_of(path, sheet)):
                    if any(v is not None and v != "" for v in r):
                        held.append((i, [_shown(v) for v in r], [_kind(v) for v in r]))
                    if len(held) == 5_000:
                        yield pd.DataFrame(held, columns=["row_", "cells_", "kinds_"])
                        held = []
                yield pd.DataFrame(held, columns=["row_", "cells_", "kinds_"])

    with Scratch(spark) as scratch:
        raw = scratch.hand_over(spark.createDataFrame([(1,)], "n int").mapInPandas(cells, "row_ bigint, cells_ array<string>, kinds_ array<string>"))
    head = [["" if v is None else v for v in r["cells_"]] for r in raw.orderBy("row_").limit(101).collect()]
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    top = delimited.has_header(head) if header is None else header
    width = raw.agg(F.max(F.size("cells_"))).first()[0]
    heads = names.column_names([*(head[0] if top else []), *[""] * (width - (len(head[0]) if top else 0))])
    first = raw.agg(F.min("row_")).first()[0]
    body = raw.where(F.col("row_") > first) if top else raw
    # One row per column and kind.
    found: dict[int, set] = {}
    for r in body.select(F.posexplode("kinds_").alias("at", "kind")).where("kind <> ''").distinct().collect():
        found.setdefault(r["at"], set()).add(r["kind"])
    columns = []
    for i, name in enumerate(heads):
        kinds, cell = found.get(i, set()), F.get("cells_", F.lit(i))
        if kinds == {"b"}:
            cell = cell.cast("boolean")
        elif kinds == {"i"}:
            cell = cell.cast("bigint")
        elif kinds and kinds <= {"i", "f"}:
            cell = cell.cast("double")
        elif kinds == {"d"}:
            cell = cell.cast("date")
        elif kinds and kinds <= {"d", "t"}:
            cell = cell.cast("timestamp_ntz")
        columns.append(cell.alias(name))
    return body.orderBy("row_").select(*columns)
