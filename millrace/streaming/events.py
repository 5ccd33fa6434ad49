"""Document events as streams: sources, fan-out, fan-in, and windows over event time.

Documents are append-only files of a folder, each with an immutable key. State is bounded by watermarks or by the runs
that are open; sinks are keyed by batch, so that a batch run again writes the same.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def created(spark: SparkSession, folder: str, schema: StructType, since: float | None = None, per_trigger: int = 1_000) -> DataFrame:
    """The stream of documents created in a folder of Parquet files. since: a time in seconds; documents of files older
    than it never fire."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    if since is not None:
        df = df.where(F.col("_metadata.file_modification_time") >= F.timestamp_seconds(F.lit(since)))
    return df


def unique(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once; what comes again within the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def split(stream: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """The documents that meet a condition, and the rest, nulls included."""
    c = F.coalesce(condition, F.lit(False))
    return stream.where(c), stream.where(~c)


def fan_out(stream: DataFrame, count_col: str, per: int, keys: list[str]) -> DataFrame:
    """(keys..., chunk, first, last, expected_total): chunks of at most ``per`` units of each document."""
    n = F.ceil(F.col(count_col) / per).cast("int")
    some = stream.where(F.col(count_col) > 0)
    out = some.select(*keys, F.col(count_col).alias("n_"), n.alias("expected_total"), F.explode(F.sequence(F.lit(1), n)).alias("chunk"))
    return out.select(*keys, "chunk", ((F.col("chunk") - 1) * per + 1).alias("first"), F.least(F.col("chunk") * per, F.col("n_")).alias("last"), "expected_total")


FAN_IN = "run_id string, results bigint, expected_total bigint, complete boolean"


def fan_in(stream: DataFrame, run: str, part: str, expected: str, wait: str | None = None) -> DataFrame:
    """(run_id, results, expected_total, complete): one row when a run's distinct parts reach its expected number, or,
    with ``wait``, when that long nothing came. A part that comes again, and anything after the row, changes nothing; a
    run's state is the parts it still needs."""
    shaped = stream.select(F.col(run).cast("string").alias("run_id"), F.col(part).cast("string").alias("part"), F.col(expected).cast("long").alias("expected"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total, done = state.get if state.exists else ("", 0, False)
        parts = set(filter(None, seen.split("\x1f")))
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame([(key[0], len(parts), total, False)], columns=["run_id", "results", "expected_total", "complete"])
            return
        for f in frames:
            parts |= set(f["part"].dropna())
            total = max(total, int(f["expected"].max()) if f["expected"].notna().any() else 0)
        if not done and total and len(parts) >= total:
            done = True
            yield pd.DataFrame([(key[0], len(parts), total, True)], columns=["run_id", "results", "expected_total", "complete"])
        state.update(("" if done else "\x1f".join(sorted(parts)), total, done))
        if wait:
            state.setTimeoutDuration(wait)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return shaped.where("run_id IS NOT NULL").groupBy("run_id").applyInPandasWithState(step, FAN_IN, "seen string, total bigint, done boolean", "append", timeout)


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Everything there is, batch by batch, through ``handle(frame, batch_id)``; ends when all is read."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    q.awaitTermination()
    return q


def write_tables(folder: str, outputs: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A handler that writes several tables of one batch, each to its own folder of the batch, which a repeated batch
    overwrites."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, make in outputs.items():
                make(batch).write.mode("overwrite").parquet(os.path.join(folder, name, f"batch={batch_id}"))
        finally:
            batch.unpersist()

    return handle


def one_by_one(order: list[str], handle: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """A handler that runs documents serially, in order; rows come to the driver one partition at a time."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for row in batch.orderBy(*order).toLocalIterator():
            handle(row.asDict())

    return run


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window start and end, keys..., events, total) over tumbling or sliding windows of event time. An addition: the
    dataflow that this engine re-expresses has no windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    a = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return a.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "events", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(session start and end, key, events): runs of events without a longer gap. An addition like ``windowed``."""
    a = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("events"))
    return a.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "events")
