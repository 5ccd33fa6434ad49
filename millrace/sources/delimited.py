"""Delimited text: delimiter, header and encoding from the first bytes, types from all rows."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import names, typed

HEAD = 256 << 10
DELIMITERS = (",", ";", "\t", "|")
MAX_COLUMNS = 2_000
#: Stands for "no null text", so that "" and nothing stay apart.
UNUSED = "\x02"


@dataclass
class Layout:
    delimiter: str
    header: bool
    encoding: str
    columns: list[str]


def encoding_of(head: bytes) -> str:
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    return "UTF-8"


def _rows(text: str, delimiter: str, most: int = 100) -> list[list[str]]:
    out = []
    try:
        for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
            if r:
                out.append(r)
            if len(out) > most:
                break
    except csv.Error:
        pass
    return out


def sniff_delimiter(text: str) -> str:
    """The largest share of rows of one width, then more rows, more fields, the earlier delimiter."""
    best, pick = None, ","
    for k, d in enumerate(DELIMITERS):
        rows = _rows(text, d)
        if not rows:
            continue
        widths = [len(r) for r in rows]
        common = max(set(widths), key=lambda w: (widths.count(w), w))
        if common < 2:
            continue
        score = (widths.count(common) / len(rows), len(rows), common, -k)
        if best is None or score > best:
            best, pick = score, d
    return pick


def has_header(rows: list[list[str]]) -> bool:
    """All filled cells of the first row are text, and a typed cell is below, or the row has no gap and no repeat."""
    if not rows:
        return False
    first = [c.strip() for c in rows[0]]
    if any(c and typed.classify(c) for c in first):
        return False
    if not any(first):
        return False
    below = any(c.strip() and typed.classify(c.strip()) for r in rows[1:] for c in r)
    return below or all(first) and len(set(first)) == len(first)


def layout(path: str, delimiter: str | None = None, header: bool | None = None) -> Layout:
    with open(path, "rb") as f:
        head = f.read(HEAD)
    encoding = encoding_of(head)
    text = head.decode("utf-16" if encoding == "UTF-16" else "utf-8-sig", "replace")
    if len(head) == HEAD and "\n" in text:
        text = text[: text.rindex("\n") + 1]
    sep = delimiter or sniff_delimiter(text)
    rows = _rows(text, sep)
    top = has_header(rows) if header is None else header
    width = max((len(r) for r in rows), default=0)
    if width > MAX_COLUMNS:
        raise ValueError(f"the file has more than {MAX_COLUMNS} columns")
    cols = rows[0] + [""] * (width - len(rows[0])) if top and rows else [""] * width
    return Layout(sep, top, encoding, names.column_names(cols))


def _line_wise(spark: SparkSession, path: str, lay: Layout) -> bool:
    if lay.encoding != "UTF-8":
        return False
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return spark.read.text(path).where(odd).isEmpty()


def read(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, types: bool = True) -> DataFrame:
    """The table of a file: short rows are filled with nulls, long ones cut; blank lines are no rows. A file without
    any row is a table without columns. A file whose quotes pair on every line has no line end in a field, and is read in
    splits; another, which a pass over its lines tells, is one task's work."""
    lay = layout(path, delimiter, header)
    if not lay.columns:
        return spark.createDataFrame([], T.StructType([]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in lay.columns])
    df = (
        spark.read.schema(schema)
        .option("sep", lay.delimiter).option("header", lay.header).option("multiLine", not _line_wise(spark, path, lay)).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        .option("nullValue", UNUSED).option("emptyValue", "").option("encoding", lay.encoding).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", False)
        .csv(path)
    )
    if not types:
        return df
    return typed.typed(df).where(F.lit(True))
