"""Result pages: exact cells, byte budgets, cursors that know what they belong to, Markdown, and profiles."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.engine.sql import Prepared, Refused, prepare, sortable

MAX_ROWS, DEFAULT_ROWS = 100_000, 200
MAX_BYTES, DEFAULT_BYTES, MIN_BYTES = 3_000_000, 1_000_000, 4_096
CELL_BYTES, MARKDOWN_CELL, MARKDOWN_BYTES = 65_536, 200, 262_144
EXACT = 2**53


def fnv(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    """64-bit FNV-1a."""
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    return h


def type_name(t: T.DataType, metadata: dict | None = None) -> str:
    """The public name of a type."""
    if (metadata or {}).get("logical"):
        return metadata["logical"]
    plain = {
        T.NullType: "null", T.BooleanType: "bool", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64",
        T.StringType: "text", T.BinaryType: "binary", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamp_tz", T.DayTimeIntervalType: "duration", T.YearMonthIntervalType: "interval",
    }
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    if isinstance(t, T.ArrayType):
        return f"list<{type_name(t.elementType)}>"
    if isinstance(t, T.StructType):
        return "struct(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in t.fields) + ")"
    if isinstance(t, T.MapType):
        return "map"
    return plain.get(type(t), t.simpleString())


def _float(x: float, single: bool):
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if single:
        # The fewest digits that read back as the same single.
        import struct

        for digits in range(1, 10):
            y = float(f"{x:.{digits}g}")
            if struct.pack("f", y) == struct.pack("f", x):
                x = y
                break
    return int(x) if x == int(x) and abs(x) < 1e15 else x


def cell(v, t: T.DataType):
    """A value as JSON without loss: integers beyond 2^53 and decimals as text, bytes in hexadecimal, ISO times."""
    if v is None:
        return None
    if isinstance(t, T.ArrayType):
        return [cell(x, t.elementType) for x in v]
    if isinstance(t, T.StructType):
        return {f.name: cell(v[i], f.dataType) for i, f in enumerate(t.fields)}
    if isinstance(t, T.MapType):
        return [[cell(k, t.keyType), cell(x, t.valueType)] for k, x in v.items()]
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v if abs(v) <= EXACT else str(v)
    if isinstance(v, float):
        return _float(v, isinstance(t, T.FloatType))
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, (bytes, bytearray)):
        v = bytes(v).hex()
    elif isinstance(v, dt.datetime):
        v = v.isoformat() + ("Z" if isinstance(t, T.TimestampType) else "")
    elif isinstance(v, (dt.date, dt.time)):
        v = v.isoformat()
    elif isinstance(v, dt.timedelta):
        v = str(v)
    if isinstance(v, str):
        raw = v.encode("utf-8", "replace")
        return v if len(raw) <= CELL_BYTES else raw[:CELL_BYTES].decode("utf-8", "ignore") + "…"
    return str(v)


def markdown(columns: list[str], rows: list[list], most: int) -> str:
    def shown(x) -> str:
        text = "NULL" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        text = re.sub(r"\r\n?|\n", "<br>", text.replace("|", "\\|"))
        return text if len(text) <= MARKDOWN_CELL else text[:MARKDOWN_CELL] + "…"

    out = ["| " + " | ".join(map(shown, columns)) + " |", "|" + " --- |" * len(columns)]
    size = sum(map(len, out))
    for r in rows[:most]:
        line = "| " + " | ".join(map(shown, r)) + " |"
        size += len(line.encode())
        if size > MARKDOWN_BYTES:
            break
        out.append(line)
    return "\n".join(out)


def write_cursor(fingerprint: int, offset: int) -> str:
    body = base64.urlsafe_b64encode(f"{fingerprint:016x}:{offset}".encode()).rstrip(b"=").decode()
    return f"dt1.{body}.{fnv(body.encode()):016x}"


def read_cursor(cursor: str, fingerprint: int) -> int:
    """The offset of a cursor; one of another query, options, data or order is refused."""
    m = re.fullmatch(r"dt1\.([A-Za-z0-9_-]+)\.([0-9a-f]{16})", cursor or "")
    if not m or f"{fnv(m[1].encode()):016x}" != m[2]:
        raise Refused("the cursor is damaged")
    own, _, offset = base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)).decode().partition(":")
    if int(own, 16) != fingerprint:
        raise Refused("the cursor belongs to another query, or the data changed")
    return int(offset)


@dataclass
class Page:
    columns: list[dict]
    rows: list[list]
    order: str
    offset: int
    next: str | None = None
    markdown: str = ""
    warnings: list[str] = field(default_factory=list)

    def json(self) -> dict:
        return {"columns": self.columns, "rows": self.rows, "row_count": len(self.rows), "offset": self.offset, "order": self.order, "markdown": self.markdown, "warnings": self.warnings, "next": self.next}


def page(spark: SparkSession, query: str | Prepared, max_rows: int = DEFAULT_ROWS, max_bytes: int = DEFAULT_BYTES, markdown_rows: int = 50, cursor: str | None = None, data: str = "") -> Page:
    """One page of a query: rows from the cursor on until ``max_rows`` or ``max_bytes`` of JSON, at least one. ``data``
    identifies the data read; with the query and the order it makes the cursor's fingerprint. Only a page of rows comes
    to the driver, one partition at a time."""
    if not 1 <= max_rows <= MAX_ROWS or not MIN_BYTES <= max_bytes <= MAX_BYTES or not 0 <= markdown_rows <= 1000:
        raise Refused("a page option is out of range")
    p = prepare(spark, query) if isinstance(query, str) else query
    fingerprint = fnv(json.dumps([p.sql, p.order, data, max_bytes]).encode())
    offset = read_cursor(cursor, fingerprint) if cursor else 0
    fields = p.df.schema.fields
    rows, size, more = [], 0, False
    for r in p.df.offset(offset).limit(max_rows + 1).toLocalIterator():
        one = [cell(v, f.dataType) for v, f in zip(r, fields)]
        size += len(json.dumps(one, separators=(",", ":"), ensure_ascii=False).encode()) + 1
        if rows and (len(rows) == max_rows or size > max_bytes):
            more = True
            break
        rows.append(one)
    columns = [{"name": f.name, "type": type_name(f.dataType, f.metadata)} for f in fields]
    return Page(columns, rows, p.order, offset, write_cursor(fingerprint, offset + len(rows)) if more else None, markdown([c["name"] for c in columns], rows, markdown_rows))


def profile(df: DataFrame, sample_rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """(column, type, rows, non_null, nulls, distinct, min, max, mean) in one pass: extremes of sortable columns as text,
    means of numbers; columns of lists, maps and structs give counts only. Of an empty table one row per column with
    zero counts."""
    part = df.limit(sample_rows) if sample_rows else df
    exprs = []
    for f in part.schema.fields:
        if columns and f.name not in columns:
            continue
        c = F.col(f"`{f.name}`")
        none = F.lit(None).cast("string")
        number = isinstance(f.dataType, T.NumericType)
        ordered = sortable(f.dataType) and not isinstance(f.dataType, (T.BinaryType, T.NullType))
        exprs.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(type_name(f.dataType, f.metadata)).alias("type"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("non_null"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"),
                (F.countDistinct(c) if ordered else F.lit(None).cast("long")).alias("distinct"), (F.min(c).cast("string") if ordered else none).alias("min"), (F.max(c).cast("string") if ordered else none).alias("max"),
                (F.avg(c.cast("double")) if number else F.lit(None).cast("double")).alias("mean"),
            ).alias(f"p{len(exprs)}")
        )
    one = part.agg(*exprs)
    return one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(exprs))])))
