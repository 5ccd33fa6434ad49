import datetime as dt

from millrace.plans import streams
from millrace.streaming import events as E

SCHEMA = "run_id string, part string, expected long, at timestamp"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return E.created(spark, folder, spark.createDataFrame([], SCHEMA).schema, per_trigger=1)


def collect(stream, folder, mode="append"):
    out = []
    E.run_once(stream, lambda b, _: out.extend(b.collect()), folder + "/cp", mode)
    return out


T = dt.datetime(2025, 1, 1)


def test_fan_in_fires_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("a", "1", 2, T), ("b", "1", 3, T)])
    put(spark, folder, [("a", "1", 2, T), ("b", "2", 3, T), (None, "9", 1, T)])
    put(spark, folder, [("a", "2", 2, T)])
    put(spark, folder, [("a", "3", 2, T)])
    got = collect(E.fan_in(source(spark, folder), "run_id", "part", "expected"), str(tmp_path))
    assert [(r.run_id, r.expected_total, r.complete) for r in got] == [("a", 2, True)]


def test_split_fan_out_and_unique(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("a", "x", 45, T), ("b", None, 0, T), ("a", "x", 45, T)])
    from pyspark.sql import functions as F

    one, rest = E.split(source(spark, folder), F.col("part") == "x")
    assert len(collect(one, str(tmp_path / "1"))) == 2 and len(collect(rest, str(tmp_path / "2"))) == 1
    chunks = collect(E.fan_out(E.unique(source(spark, folder), "run_id", "at"), "expected", 20, ["run_id"]), str(tmp_path / "3"))
    assert sorted((r.run_id, r.chunk, r.first, r.last, r.expected_total) for r in chunks) == [("a", 1, 1, 20, 3), ("a", 2, 21, 40, 3), ("a", 3, 41, 45, 3)]


def test_only_documents_from_now_on(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("a", "x", 1, T)])
    late = E.created(spark, folder, spark.createDataFrame([], SCHEMA).schema, since=4_000_000_000)
    assert collect(late, str(tmp_path)) == []


def test_tables_of_a_batch_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("a", "x", 1, T), ("b", "y", 2, T)])
    handle = E.write_tables(str(tmp_path / "out"), {"runs": lambda b: b.select("run_id"), "parts": lambda b: b.select("part")})
    E.run_once(source(spark, folder), handle, str(tmp_path / "cp"))
    batch = spark.read.schema(SCHEMA).parquet(folder)
    handle(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 2
    seen = []
    E.one_by_one(["run_id"], lambda d: seen.append(d["run_id"]))(batch, 0)
    assert seen == ["a", "b"]


def test_stream_equals_batch(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    got = {(r.window_start, r.event_type): r.events for r in streams.QUERIES["stream_tumbling"](spark, d).collect()}
    from pyspark.sql import functions as F

    batch = spark.read.parquet(f"{d}/events.parquet").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("w"), "event_type").count().collect()
    assert got == {(r.w, r.event_type): r["count"] for r in batch}
