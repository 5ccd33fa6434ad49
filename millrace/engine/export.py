"""Whole results to one file, published at once."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.engine.sql import Refused, prepare


def csv_cell(c: Column, t: T.DataType) -> Column:
    """A value as a field: nothing for null, "" for empty text, quotes around what a reader could take apart."""
    if isinstance(t, T.BinaryType):
        text = F.lower(F.hex(c))
    elif isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c)
    elif isinstance(t, T.TimestampType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(t, T.TimestampNTZType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        text = c.cast("string")
    if isinstance(t, T.StringType):
        text = F.when(text == "", F.lit('""')).when(text.rlike(r"[,;|\t\"\r\n]|^\s|\s$"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    elif isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(text, F.lit("")) if not isinstance(t, T.NullType) else F.lit("")


def csv_lines(df: DataFrame) -> DataFrame:
    """One text column with a line per row. The null of a one-column table is "", or its line would be blank."""
    fields = df.schema.fields
    cells = [csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in fields]
    line = cells[0] if len(cells) == 1 else F.concat_ws(",", *cells)
    return df.select((F.when(line == "", F.lit('""')).otherwise(line) if len(cells) == 1 else line).alias("value"))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(ch in name for ch in ',;|\t"\r\n') or name != name.strip() or not name else name


def export(spark: SparkSession, sql: str, folder: str, name: str, kind: str | None = None, overwrite: bool = False) -> dict:
    """Writes a query's result to ``folder``/``name`` as csv or parquet: to a hidden place first, then linked, so that a
    reader sees all of it or nothing; without ``overwrite`` an existing file is kept and the export refused."""
    from millrace.engine.catalog import valid_output

    target = Path(folder) / valid_output(name)
    kind = kind or ("parquet" if name.endswith(".parquet") else "csv")
    if kind not in ("csv", "parquet"):
        raise Refused(f"unknown format {kind}")
    if target.exists() and not overwrite:
        raise Refused(f"{name} exists")
    p = prepare(spark, sql)
    hidden = Path(folder) / f".{uuid.uuid4().hex}"
    try:
        rows = p.df
        one = (csv_lines(rows) if kind == "csv" else rows).coalesce(1)
        if kind == "csv":
            one.write.option("lineSep", "\n").text(str(hidden))
        else:
            one.write.option("compression", "snappy").parquet(str(hidden))
        part = next(x for x in sorted(hidden.iterdir()) if x.name.startswith("part-"))
        if kind == "csv":
            whole = hidden / "whole"
            with open(whole, "wb") as out, open(part, "rb") as body:
                out.write((",".join(map(_quoted, p.df.columns)) + "\n").encode())
                shutil.copyfileobj(body, out)
            part = whole
        if overwrite:
            os.replace(part, target)
        else:
            os.link(part, target)
        n = spark.read.parquet(str(target)).count() if kind == "parquet" else None
        return {"output": name, "format": kind, "order": p.order, "bytes": target.stat().st_size} | ({"rows": n} if n is not None else {})
    finally:
        shutil.rmtree(hidden, ignore_errors=True)
