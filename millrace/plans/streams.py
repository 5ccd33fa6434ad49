"""Streaming queries run to their end over the test tables, and what a batch query gives for the same."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine.session import shared_dir
from millrace.streaming import events as E

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    base = shared_dir(spark)
    return f"{base}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(os.path.dirname(path))


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until all is read, as a table in the shared folder."""
    spark, place = stream.sparkSession, _place(stream.sparkSession)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # In complete mode the last batch is the whole result.
        batch.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={batch_id}")

    E.run_once(stream, handle, f"{place}/checkpoint", mode)
    schema = stream.schema
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{place}/out")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    e = _source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(E.windowed(e, "ts", ["event_type"], "value"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT w AS window_start, event_type, CAST(count(*) AS BIGINT) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2")
def stream_sliding(spark, d):
    e = _source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(E.windowed(e, "ts", ["event_type"], "value", "1 hour", "30 minutes"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE s) AS BIGINT) AS sessions FROM (SELECT user_id, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL, true) AS s FROM events) GROUP BY 1")
def stream_sessions(spark, d):
    """Sessions of the stream, those still open at its end included; the watermark is far back, so that no event is late."""
    e = _source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = _drained(E.sessions(e, "ts", "user_id", late="3650 days"), "complete")
    return s.groupBy("user_id").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("sessions"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS events FROM events WHERE event_type = 'purchase' AND value > 0 GROUP BY 1 UNION ALL SELECT 'rest', count(*) FROM events WHERE NOT coalesce(event_type = 'purchase' AND value > 0, false)")
def stream_split(spark, d):
    a, b = E.split(_source(spark, d, "events"), (F.col("event_type") == "purchase") & (F.col("value") > 0))
    one = _drained(a.select("event_type"))
    two = _drained(b.select(F.lit("rest").alias("event_type")))
    return one.unionByName(two).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT CAST(count(DISTINCT page_id) AS BIGINT) AS documents FROM ocr_page")
def stream_unique(spark, d):
    s = _source(spark, d, "ocr_page").withColumn("t", F.coalesce(F.col("created_at"), F.expr("TIMESTAMP_NTZ'2025-01-01 00:00:00'")).cast("timestamp"))
    return _drained(E.unique(s, "page_id", "t", "3650 days").select("page_id")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT record_id, CAST(c AS INTEGER) AS chunk, (c - 1) * 20 + 1 AS first, least(c * 20, page_count) AS last, CAST(ceil(page_count / 20.0) AS INTEGER) AS expected_total FROM (SELECT DISTINCT record_id, page_count, unnest(range(1, CAST(ceil(page_count / 20.0) AS BIGINT) + 1)) AS c FROM ocr_document WHERE page_count > 0)")
def stream_fan_out(spark, d):
    s = _source(spark, d, "ocr_document").select("record_id", "page_count")
    return _drained(E.fan_out(s, "page_count", 20, ["record_id"])).distinct().select("record_id", "chunk", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "expected_total")


@query("SELECT run_id, CAST(count(DISTINCT record_id) AS BIGINT) AS results FROM completion WHERE run_id IS NOT NULL AND record_type = 'InvestigationResult' GROUP BY 1 HAVING count(DISTINCT record_id) >= max(try_cast(expected_total AS BIGINT))")
def stream_fan_in(spark, d):
    """Runs whose results are all there; in one drained batch a run fires with all it has."""
    s = _source(spark, d, "completion").where("record_type = 'InvestigationResult'").withColumn("expected", F.expr("try_cast(expected_total AS bigint)"))
    return _drained(E.fan_in(s, "run_id", "record_id", "expected")).select("run_id", "results")
