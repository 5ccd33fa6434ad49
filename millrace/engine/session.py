"""Session settings and the tables of a delivery folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the engine's semantics rest on; all can be set at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for local use and tests. A cluster's own session is used as it is."""
    builder = SparkSession.builder.master(master).config("spark.ui.enabled", "false")
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder, one Parquet file or directory each."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in ``spark.checkpoint.dir``; only where it is unset
    (tests, a single machine) a temporary one is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, place: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, place: str) -> None:
    try:
        _remove(spark, place)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner clears it
        pass


class Scratch:
    """Tables written to the shared folder while an operator works; they are removed with it, but for what ``hand_over``
    returns, which goes with the application.

    A written table cuts the lineage like a checkpoint, and is columnar and compressed.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.place, self.count = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        _remove(self.spark, self.place)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return self._written(df, f"{self.place}/{self.count}")

    def hand_over(self, df: DataFrame) -> DataFrame:
        place = f"{shared_dir(self.spark)}/result-{uuid.uuid4().hex}"
        out = self._written(df, place)
        atexit.register(_remove_at_exit, self.spark, place)
        return out

    def _written(self, df: DataFrame, place: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)
