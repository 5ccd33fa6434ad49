"""JSON: arrays, one value a line, or any concatenated values, with column types merged over all values."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import names

MAX_DEPTH, EXACT = 128, 2**53


def values(text: str) -> Iterator[object]:
    """Every element: of a top-level array its elements, else the concatenated values."""
    decoder, i, text = json.JSONDecoder(), 0, text.lstrip("﻿")
    n = len(text)
    while i < n:
        while i < n and text[i] in " \t\r\n,":
            i += 1
        if i >= n:
            return
        value, i = decoder.raw_decode(text, i)
        yield from value if isinstance(value, list) else (value,)


def _kind(v, depth: int = 0):
    if depth > MAX_DEPTH:
        raise ValueError("the JSON is nested too deeply")
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return ("int", abs(v) > EXACT) if -(2**63) <= v < 2**63 else "text"
    if isinstance(v, float):
        return "float"
    if isinstance(v, str):
        return "text"
    if isinstance(v, list):
        inner = "null"
        for x in v:
            inner = merge(inner, _kind(x, depth + 1))
        return ("list", inner)
    return ("struct", {k: _kind(x, depth + 1) for k, x in v.items()})


def merge(a, b):
    """The type that holds both: an integer beyond 2^53 beside a float, and any unlike pair, is text."""
    if a == "null" or a == b:
        return b
    if b == "null":
        return a
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0]:
        if a[0] == "int":
            return ("int", a[1] or b[1])
        if a[0] == "list":
            return ("list", merge(a[1], b[1]))
        keys = {**a[1], **b[1]}
        return ("struct", {k: merge(a[1].get(k, "null"), b[1].get(k, "null")) for k in keys})
    pair = {a if isinstance(a, str) else a[0], b if isinstance(b, str) else b[0]}
    if pair == {"int", "float"}:
        big = (a if isinstance(a, tuple) else b)[1]
        return "text" if big else "float"
    return "text"


def spark_type(kind) -> T.DataType:
    if isinstance(kind, tuple):
        if kind[0] == "int":
            return T.LongType()
        if kind[0] == "list":
            return T.ArrayType(spark_type(kind[1]))
        return T.StructType([T.StructField(k, spark_type(x)) for k, x in kind[1].items()])
    return {"bool": T.BooleanType(), "float": T.DoubleType()}.get(kind, T.StringType())


def fit(v, kind):
    """The value as its merged type has it; unlike values as compact JSON text."""
    if v is None:
        return None
    if isinstance(kind, tuple) and kind[0] == "list" and isinstance(v, list):
        return [fit(x, kind[1]) for x in v]
    if isinstance(kind, tuple) and kind[0] == "struct" and isinstance(v, dict):
        return {k: fit(v.get(k), x) for k, x in kind[1].items()}
    if kind == "float":
        return float(v)
    if kind in ("text", "null") and not isinstance(v, str):
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return v


#: Fixed value: bytes of a file that is one array or value.
MAX_ARRAY = 64 << 20


def _record(v) -> dict:
    return v if isinstance(v, dict) else {"value": v}


def _merged(kinds: Iterator) -> dict:
    total = ("struct", {})
    for k in kinds:
        total = merge(total, k)
    return total


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table of a JSON file, keys in order of their first appearance, missing ones null; values that are no objects
    are in a column ``value``. Files of one value a line are read and typed in parallel; an array is one task's work, and
    refused above ``MAX_ARRAY`` bytes: lines of JSON have no limit."""
    with open(path, "rb") as f:
        head = f.read(1 << 16).decode("utf-8-sig", "replace").lstrip()
    lines = head[:1] == "{" and _line_wise(head)
    if lines:
        raw = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("v"))
        n = raw.rdd.getNumPartitions()
    else:
        if os.path.getsize(path) > MAX_ARRAY:
            raise ValueError(f"a JSON file of more than {MAX_ARRAY >> 20} MiB must have one value a line")
        raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
        n = 1

    def kinds(batches):
        import pandas as pd

        total = ("struct", {})
        for b in batches:
            for text in b["v"]:
                for v in values(text):
                    total = merge(total, _kind(_record(v)))
        yield pd.DataFrame({"k": [repr(total)]})

    import ast

    total = _merged(ast.literal_eval(r["k"]) for r in raw.mapInPandas(kinds, "k string").collect()) if n else ("struct", {})
    columns = names.distinct(list(total[1])) if total[1] else []
    schema = T.StructType([T.StructField(c, spark_type(k)) for c, k in zip(columns, total[1].values())])
    if not columns:
        return spark.createDataFrame([], schema)

    def rows(batches):
        import pandas as pd

        for b in batches:
            out = [json.dumps({f"c{i}": fit(_record(v).get(k), x) for i, (k, x) in enumerate(total[1].items())}, ensure_ascii=False) for text in b["v"] for v in values(text)]
            yield pd.DataFrame({"r": out}, dtype=object)

    # One object a record under plain keys, which Spark reads with the exact types.
    shape = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    boxed = raw.mapInPandas(rows, "r string").select(F.from_json("r", shape).alias("s"))
    return boxed.select(*[F.col(f"s.c{i}").alias(c) for i, c in enumerate(columns)])


def _line_wise(head: str) -> bool:
    first = head.split("\n", 1)[0]
    try:
        json.loads(first)
    except ValueError:
        return False
    return True
