"""Narrow types of text columns, found over all rows in one aggregate.

A column starts with every possibility; each value that isn't empty takes away those it doesn't fit; the first that is
left in the order bool, int, float, date, timestamp, timestamp with zone is the type, text if none is. The rules are the
same as Spark expressions and in Python, where headers are told from data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOL, INT, FLOAT, DATE, STAMP, ZONED = 1, 2, 4, 8, 16, 32
ALL = 63

_INT = r"^-?(?:0|[1-9][0-9]{0,18})$"
_FLOAT = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?$"
_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-](?:0[0-9]|1[0-4]):?[0-5][0-9])$"
#: An integer of more digits than a float holds; beside a float it makes the column text.
_LONG_INT = r"^-?[0-9]{16,}$"

SPARK_TYPE = {BOOL: T.BooleanType(), INT: T.LongType(), FLOAT: T.DoubleType(), DATE: T.DateType(), STAMP: T.TimestampNTZType(), ZONED: T.TimestampType(), 0: T.StringType()}


def classify(value: str) -> int:
    """The possibilities of one value."""
    import datetime as dt

    if value.lower() in ("true", "false"):
        return BOOL
    if re.fullmatch(_INT, value):
        return INT | FLOAT if -(2**63) <= int(value) < 2**63 else 0
    if re.fullmatch(_FLOAT, value):
        return FLOAT if abs(float(value)) != float("inf") else 0
    for pattern, bits in ((_DATE, DATE), (_STAMP, STAMP), (_ZONED, ZONED)):
        if re.fullmatch(pattern, value):
            try:
                dt.datetime.fromisoformat(value.replace(" ", "T").replace("Z", "+00:00"))
            except ValueError:
                return 0
            return bits
    return 0


def classes(c: Column) -> Column:
    """``classify`` as a column; null for null and empty."""
    v = (
        F.when(F.lower(c).isin("true", "false"), BOOL)
        .when(c.rlike(_INT), F.when(c.try_cast("long").isNotNull(), INT | FLOAT).otherwise(0))
        .when(c.rlike(_FLOAT), F.when(F.abs(c.try_cast("double")) != float("inf"), FLOAT).otherwise(0))
        .when(c.rlike(_DATE), F.when(c.try_cast("date").isNotNull(), DATE).otherwise(0))
        .when(c.rlike(_STAMP), F.when(F.to_timestamp_ntz(F.when(F.try_to_timestamp(c).isNotNull(), c)).isNotNull(), STAMP).otherwise(0))
        .when(c.rlike(_ZONED), F.when(F.try_to_timestamp(c).isNotNull(), ZONED).otherwise(0))
        .otherwise(0)
    )
    return F.when(c.isNotNull() & (c != ""), v.cast("int"))


def infer(df: DataFrame) -> dict[str, int]:
    """The class of every column, in one pass over all rows; a column that never holds a value is text."""
    exprs = []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        exprs += [F.bit_and(classes(col)).alias(f"b{i}"), F.max(col.rlike(_LONG_INT)).alias(f"l{i}"), F.max(classes(col) == FLOAT).alias(f"f{i}")]
    row = df.agg(*exprs).first() if exprs else {}
    out = {}
    for i, c in enumerate(df.columns):
        bits = row[f"b{i}"]
        if bits is None or bits & FLOAT and not bits & INT and row[f"l{i}"]:
            bits = 0
        out[c] = next((b for b in (BOOL, INT, FLOAT, DATE, STAMP, ZONED) if bits & b), 0)
    return out


def typed(df: DataFrame, found: dict[str, int] | None = None) -> DataFrame:
    """``df`` of text columns with their types: an empty value is null in a typed column, "" in a text one."""
    found = infer(df) if found is None else found
    cols = []
    for c in df.columns:
        col, kind = F.col(f"`{c}`"), found[c]
        some = F.when(col != "", col)
        cols.append((col if not kind else F.to_timestamp_ntz(some) if kind == STAMP else some.cast(SPARK_TYPE[kind])).alias(c))
    return df.select(*cols)
