"""Keys on their way through Python: as text, since a null among integers would turn a batch of them into floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(col: str, name: str = "id_") -> Column:
    return F.col(col).cast("string").alias(name)


def restored(df: DataFrame, col: str, kind: str, name: str = "id_") -> DataFrame:
    """``df`` with the key ``name`` under its own name and type again, in its place."""
    return df.select(*[F.col(name).cast(kind).alias(col) if c == name else F.col(c) for c in df.columns])
