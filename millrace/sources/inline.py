"""Tables sent as rows: declared types or types found, rows as lists or objects."""

from __future__ import annotations

import datetime as dt
import decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.sources import jsons, names

MAX_ROWS, MAX_CELLS = 1_000_000, 20_000_000

DECLARED = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(),
    "float64": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamp_tz": T.TimestampType(),
}


def _value(v, kind: str):
    if v is None:
        return None
    if kind.startswith("int"):
        return int(v)
    if kind == "uint64":
        n = int(v)
        if not 0 <= n < 2**64:
            raise ValueError(f"{v} is no uint64")
        return decimal.Decimal(n)
    if kind.startswith("float"):
        return float(v)
    if kind == "bool":
        if isinstance(v, bool):
            return v
        raise ValueError(f"{v} is no bool")
    if kind == "date":
        return dt.date.fromisoformat(v)
    if kind == "timestamp":
        return dt.datetime.fromisoformat(v)
    if kind == "timestamp_tz":
        t = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
        return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return v if isinstance(v, str) else jsons.fit(v, "text")


def table(spark: SparkSession, rows: list, columns: list | None = None) -> tuple[DataFrame, list[str]]:
    """(table, warnings). columns: names, or objects of name and type; without types they are found. Rows are lists or
    objects; missing values are null, further ones are left out with a warning."""
    if len(rows) > MAX_ROWS:
        raise ValueError(f"an inline table has at most {MAX_ROWS} rows")
    warnings: list[str] = []
    given = [c if isinstance(c, dict) else {"name": c} for c in columns or []]
    if not given:
        keys: dict = {}
        for r in rows:
            for k in r if isinstance(r, dict) else range(len(r)):
                keys.setdefault(k)
        given = [{"name": k if isinstance(k, str) else f"column_{k + 1}", "key": k} for k in keys]
    labels = names.column_names([str(c["name"]) for c in given])
    if len(rows) * len(labels) > MAX_CELLS:
        raise ValueError(f"an inline table has at most {MAX_CELLS} cells")

    def cells(r) -> list:
        if isinstance(r, dict):
            own = [r.get(c.get("key", c["name"])) for c in given]
            if set(r) - {c.get("key", c["name"]) for c in given} and "values without a column were left out" not in warnings:
                warnings.append("values without a column were left out")
            return own
        if len(r) > len(given) and "values without a column were left out" not in warnings:
            warnings.append("values without a column were left out")
        return (list(r) + [None] * len(given))[: len(given)]

    body = [cells(r) for r in rows]
    fields, kinds = [], []
    for i, (c, label) in enumerate(zip(given, labels)):
        if c.get("type"):
            kinds.append(c["type"])
            fields.append(T.StructField(label, DECLARED.get(c["type"], T.StringType()), True, {"logical": "uint64"} if c["type"] == "uint64" else {}))
        else:
            found = "null"
            for r in body:
                found = jsons.merge(found, jsons._kind(r[i]))
            kinds.append(found)
            fields.append(T.StructField(label, jsons.spark_type(found)))
    data = [tuple(_value(v, k) if isinstance(k, str) and k in DECLARED or given[i].get("type") else jsons.fit(v, k) for i, (v, k) in enumerate(zip(r, kinds))) for r in body]
    return spark.createDataFrame(data, T.StructType(fields)), warnings
