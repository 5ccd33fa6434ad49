"""Chart reductions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.engine.session import table
from millrace.operators import charts as C

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderpriority AS category, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def chart_totals(spark, d):
    return C.totals(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").withColumn("total", F.round("total", 2))


@query("SELECT event_type AS category, CAST(CAST(ts AS DATE) AS VARCHAR) AS series, round(avg(value), 6) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2")
def chart_grid(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    return C.grid(e, "event_type", "day", "value", "mean").withColumn("value", F.round("value", 6))


@query("SELECT event_type AS series, date_trunc('hour', ts) AS x, round(median(value), 6) AS y FROM events GROUP BY 1, 2")
def chart_line(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return C.line(e, "hour", "value", "event_type", "median").withColumn("y", F.round("y", 6))


@query("""WITH t AS (SELECT p_brand AS category, sum(p_retailprice) AS total FROM part GROUP BY 1 HAVING sum(p_retailprice) > 0), p AS (SELECT *, row_number() OVER (ORDER BY total DESC, category) AS place, count(*) OVER () AS n, sum(total) OVER () AS whole FROM t),
s AS (SELECT category, total, place, whole FROM p WHERE n <= 12 OR place < 12 UNION ALL SELECT 'Other', sum(total), 12, max(whole) FROM p WHERE n > 12 AND place >= 12 HAVING count(*) > 0),
a AS (SELECT *, sum(total) OVER (ORDER BY place) AS run, max(place) OVER () AS last FROM s)
SELECT category, round(total, 4) AS total, round(total / whole, 6) AS share, round((run - total) / whole * 360, 4) AS from_angle, CASE WHEN place = last THEN 360.0 ELSE round(run / whole * 360, 4) END AS to_angle FROM a""")
def chart_pie(spark, d):
    p = C.pie(table(spark, d, "part"), "p_brand", "p_retailprice")
    return p.select("category", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"), F.round("from_angle", 4).alias("from_angle"), F.round("to_angle", 4).alias("to_angle"))


@query("""WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), b AS (SELECT least(CAST(floor((c_acctbal - lo) / (hi - lo) * 16) AS BIGINT), 15) AS bin FROM customer, m WHERE c_acctbal IS NOT NULL)
SELECT i AS bin, round(lo + (hi - lo) * i / 16, 6) AS low, round(lo + (hi - lo) * (i + 1) / 16, 6) AS high, CAST((SELECT count(*) FROM b WHERE bin = i) AS BIGINT) AS count FROM (SELECT unnest(range(16)) AS i) t, m""")
def chart_histogram(spark, d):
    h = C.histogram(table(spark, d, "customer"), "c_acctbal", 16)
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query("""WITH b AS (SELECT least(CAST(floor(l_quantity / 2) AS BIGINT), 24) AS bin FROM lineitem WHERE l_quantity IS NOT NULL)
SELECT i AS bin, i * 2.0 AS low, (i + 1) * 2.0 AS high, CAST((SELECT count(*) FROM b WHERE bin = i) AS BIGINT) AS count FROM (SELECT unnest(range(25)) AS i) t""")
def chart_histogram_nice(spark, d):
    """Quantities run from 1 to 50; with the rows from sf 0.01 on the nice step is 2."""
    return C.histogram(table(spark, d, "lineitem"), "l_quantity")


@query("""WITH v AS (SELECT c_mktsegment AS category, c_acctbal AS v FROM customer WHERE c_acctbal IS NOT NULL), q AS (SELECT category, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
SELECT q.category, CAST(n AS BIGINT) AS n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, CAST(count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers FROM v JOIN q USING (category) GROUP BY ALL""")
def chart_box(spark, d):
    b = C.box(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return b.select("category", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "low", "high", "outliers")


@query("SELECT p_brand AS series, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 3 THEN round(corr(p_size, p_retailprice), 6) END AS r FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY 1")
def chart_correlation(spark, d):
    return C.correlation(table(spark, d, "part"), "p_size", "p_retailprice", "p_brand").withColumn("r", F.round("r", 6))


@query("""WITH g AS (SELECT c_mktsegment AS x, c_nationkey AS y, avg(c_acctbal) AS value FROM customer GROUP BY 1, 2), s AS (SELECT min(value) AS lo, max(value) AS hi FROM g)
SELECT x, y, round(value, 6) AS value, round(CASE WHEN lo = hi THEN 0.5 WHEN lo < 0 AND hi > 0 THEN 0.5 + value / (2 * greatest(abs(lo), abs(hi))) ELSE (value - lo) / (hi - lo) END, 6) AS norm FROM g, s""")
def chart_heatmap(spark, d):
    h = C.heatmap(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal")
    return h.select("x", "y", F.round("value", 6).alias("value"), F.round("norm", 6).alias("norm"))


@query("""WITH g AS (SELECT c_nationkey AS category, c_mktsegment AS series, sum(c_acctbal) AS value FROM customer GROUP BY 1, 2), r AS (SELECT *, sum(value) OVER (PARTITION BY category, value < 0 ORDER BY series) AS run FROM g)
SELECT category, series, round(value, 4) AS value, round(run - value, 4) AS low, round(run, 4) AS high FROM r""")
def chart_stack(spark, d):
    s = C.stack(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return s.select("category", "series", *[F.round(c, 4).alias(c) for c in ("value", "low", "high")])


@query("SELECT event_type AS series, CAST(count(value) AS BIGINT) AS points, CAST(count(*) - count(value) AS BIGINT) AS gaps, round(sum(value), 4) AS total, min(value) AS low, arg_min(event_id, (value, event_id)) FILTER (WHERE value IS NOT NULL) AS low_x, max(value) AS high, arg_min(event_id, (-value, event_id)) FILTER (WHERE value IS NOT NULL) AS high_x FROM events GROUP BY 1")
def chart_extremes(spark, d):
    return C.extremes(table(spark, d, "events"), "event_type", "event_id", "value").withColumn("total", F.round("total", 4))


@query("""SELECT round(avg(p_size), 6) AS x, round(avg(p_retailprice), 6) AS y, CAST(count(*) AS BIGINT) AS n FROM part, (SELECT min(p_size) AS lx, min(p_retailprice) AS ly FROM part) GROUP BY floor((p_size - lx) / 128), floor((p_retailprice - ly) / 128)
UNION ALL SELECT DISTINCT round(e.x, 6), round(e.y, 6), 1 FROM (SELECT unnest([min({'x': p_size, 'y': p_retailprice}), arg_max({'x': p_size, 'y': p_retailprice}, {'a': p_size, 'b': -p_retailprice}), arg_min({'x': p_size, 'y': p_retailprice}, {'a': p_retailprice, 'b': p_size}), arg_max({'x': p_size, 'y': p_retailprice}, {'a': p_retailprice, 'b': -p_size})]) AS e FROM part)""")
def chart_scatter(spark, d):
    s = C.scatter(table(spark, d, "part"), "p_size", "p_retailprice", most=1, sizes=(128,))
    return s.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50")
def chart_bubbles(spark, d):
    return C.bubbles(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"], 50)


@query("""WITH p AS (SELECT event_type AS series, epoch_us(ts) / 1e6 AS x, value AS y FROM events WHERE value IS NOT NULL AND ts IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY x, y) AS a, row_number() OVER (PARTITION BY series ORDER BY x DESC, y DESC) AS z, count(*) OVER (PARTITION BY series) AS n FROM p)
SELECT series, n > 200 AS reduced, round(min(x), 6) AS first_x, round(min(y) FILTER (WHERE a = 1), 6) AS first_y, round(max(x), 6) AS last_x, round(min(y) FILTER (WHERE z = 1), 6) AS last_y, min(y) AS low, max(y) AS high, true AS few FROM o GROUP BY ALL""")
def chart_downsample_ends(spark, d):
    """What a reduced line must keep: its ends and extremes, and no more points than were asked for and the extremes."""
    e = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    n = e.where("value IS NOT NULL AND s IS NOT NULL").groupBy(F.col("event_type").alias("series")).agg((F.count(F.lit(1)) > 200).alias("reduced"))
    k = C.downsample(e, "s", "value", 200, "event_type").groupBy("series").agg(
        F.round(F.min("x"), 6).alias("first_x"), F.round(F.min_by("y", F.struct("x", "y")), 6).alias("first_y"), F.round(F.max("x"), 6).alias("last_x"), F.round(F.max_by("y", F.struct("x", "y")), 6).alias("last_y"),
        F.min("y").alias("low"), F.max("y").alias("high"), (F.count(F.lit(1)) <= 202).alias("few"),
    )
    return n.join(k, "series")


@query("""WITH v AS (SELECT event_type AS category, value AS v FROM events WHERE value IS NOT NULL), q AS (SELECT category, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
SELECT category, v AS value, CAST(count(*) AS BIGINT) AS count FROM v JOIN q USING (category) WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def chart_outliers(spark, d):
    return C.outliers(table(spark, d, "events"), "value", "event_type")


@query(None)
def chart_downsample(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return C.downsample(e, "s", "value", 200, "event_type")


@query("SELECT p_type AS label, CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS place FROM (SELECT DISTINCT p_type FROM part)")
def chart_label_order(spark, d):
    return C.label_order(table(spark, d, "part"), "p_type")


@query("SELECT * FROM (SELECT 'c_acctbal' AS \"column\", CAST(count(c_acctbal) AS BIGINT) AS numbers, CAST(0 AS BIGINT) AS times, CAST(0 AS BIGINT) AS texts, 'numeric' AS kind FROM customer UNION ALL SELECT 'c_custkey', count(*), 0, 0, 'numeric' FROM customer UNION ALL SELECT 'c_mktsegment', 0, 0, count(c_mktsegment), 'text' FROM customer)")
def chart_column_kinds(spark, d):
    return C.column_kinds(table(spark, d, "customer").select("c_acctbal", "c_custkey", "c_mktsegment"))
