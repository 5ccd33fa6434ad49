"""The SQL surface, profiles, sources, pages and crawls over the test tables, with their SQL."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine.export import csv_lines, export
from millrace.engine.page import profile
from millrace.engine.session import shared_dir, table
from millrace.engine.sql import prepare
from millrace.functions import scalars as S
from millrace.functions import text as X
from millrace.operators import pages
from millrace.sources import delimited, inline, jsons

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    for t in tables:
        table(spark, d, t).createOrReplaceTempView(f"m_{t}")
    return prepare(spark, text).df


@query("SELECT o_orderkey // 7 AS w, o_totalprice / 2 AS h, o_orderkey + 2147483647 AS big, 1.5::DOUBLE AS d FROM orders WHERE o_orderkey // 7 * 7 = o_orderkey")
def engine_dialect(spark, d):
    return _sql(spark, d, "SELECT o_orderkey / 7 AS w, o_totalprice / 2 AS h, o_orderkey + 2147483647 AS big, 1.5 AS d FROM m_orders WHERE o_orderkey / 7 * 7 = o_orderkey", "orders")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN CASE WHEN l_tax > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END ELSE round(CAST(l_tax AS DOUBLE) / CAST(l_discount AS DOUBLE), 6) END AS ratio,
round(sqrt(CAST(l_extendedprice AS DOUBLE)), 6) AS root FROM lineitem""")
def engine_floats(spark, d):
    return _sql(spark, d, "SELECT l_orderkey, l_linenumber, round(CAST(l_tax AS DOUBLE) / CAST(l_discount AS DOUBLE), 6) AS ratio, round(sqrt(CAST(l_extendedprice AS DOUBLE)), 6) AS root FROM m_lineitem", "lineitem")


@query("SELECT n_regionkey AS k, CAST(CAST(sum(n_nationkey) AS HUGEINT) + 9223372036854775807 AS VARCHAR) AS total, CAST(sum(n_nationkey) AS VARCHAR) AS plain FROM nation GROUP BY 1")
def engine_unsigned(spark, d):
    return _sql(spark, d, "SELECT n_regionkey AS k, CAST(sum(CAST(n_nationkey AS BIGINT UNSIGNED)) + 9223372036854775807 AS STRING) AS total, CAST(sum(n_nationkey) AS STRING) AS plain FROM m_nation GROUP BY n_regionkey", "nation")


@query("SELECT DISTINCT event_type, true AS near FROM events")
def engine_approximate(spark, d):
    return _sql(spark, d, "SELECT event_type, abs(approx_distinct(user_id) - count(DISTINCT user_id)) * 10 <= count(DISTINCT user_id) AS near FROM m_events GROUP BY event_type", "events")


@query("SELECT vec_id, embedding[1] AS one, embedding[2] AS two FROM embeddings")
def engine_subscripts(spark, d):
    return _sql(spark, d, "SELECT vec_id, e.embedding[1] AS one, e.embedding[2] AS two FROM m_embeddings e", "embeddings")


@query("SELECT n_nationkey AS k, CAST(unnest(range(0, n_nationkey)) AS BIGINT) AS i FROM nation WHERE n_nationkey BETWEEN 1 AND 5")
def engine_ranges(spark, d):
    return _sql(spark, d, "SELECT n_nationkey AS k, unnest(range(0, n_nationkey)) AS i FROM m_nation WHERE n_nationkey BETWEEN 1 AND 5", "nation")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 7 OFFSET 3")
def engine_offset_first(spark, d):
    return _sql(spark, d, "SELECT o_orderkey FROM m_orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey OFFSET 3 LIMIT 7", "orders")


@query("""SELECT 'o_orderkey' AS "column", 'int64' AS type, CAST(count(*) AS BIGINT) AS rows, CAST(count(o_orderkey) AS BIGINT) AS non_null, CAST(count(*) - count(o_orderkey) AS BIGINT) AS nulls, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS "distinct", CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max, round(avg(o_orderkey), 4) AS mean FROM orders
UNION ALL SELECT 'o_orderstatus', 'text', count(*), count(o_orderstatus), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus), NULL FROM orders""")
def engine_profile(spark, d):
    return profile(table(spark, d, "orders").select("o_orderkey", "o_orderstatus")).withColumn("mean", F.round("mean", 4))


def _place(spark: SparkSession, name: str) -> str:
    base = shared_dir(spark)
    folder = os.path.join(base[5:] if base.startswith("file:") else base, f"files-{uuid.uuid4().hex}")
    while folder.startswith("//"):
        folder = folder[1:]
    os.makedirs(folder)
    return os.path.join(folder, name)


@query("SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars, pack, path, created_at FROM documents")
def source_csv(spark, d):
    """All documents exported by a task as text with quoted line ends, and read again with the types found over all rows."""
    path = _place(spark, "documents.csv")
    table(spark, d, "documents").createOrReplaceTempView("m_documents")
    export(spark, "SELECT doc_id, text, lang, source, n_chars, pack, path, created_at FROM m_documents", os.path.dirname(path), os.path.basename(path))
    return delimited.read(spark, path)


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders")
def source_csv_lines(spark, d):
    """All orders exported as text without line ends in fields, so that it is read again in splits."""
    path = _place(spark, "orders.csv")
    table(spark, d, "orders").createOrReplaceTempView("m_orders")
    export(spark, "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM m_orders", os.path.dirname(path), os.path.basename(path))
    return delimited.read(spark, path)


@query("SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars, pack, path, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM documents")
def source_json(spark, d):
    """All documents written as JSON lines by a task, and read again in splits, with the types merged over all lines."""
    path = _place(spark, "documents.ndjson")
    stamp = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars", "pack", "path", stamp)
    docs.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(f"{path}.parts")
    parts = [x for x in os.listdir(f"{path}.parts") if x.startswith("part-")]
    os.rename(f"{path}.parts/{parts[0]}", path)
    return jsons.read(spark, path)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST('NaN' AS DOUBLE)), (2, NULL, 0.5)) t(k, v, x)")
def source_inline(spark, d):
    return inline.table(spark, [[1, "a", "NaN"], {"k": "2", "x": 0.5}], [{"name": "k", "type": "int64"}, "v", {"name": "x", "type": "float64"}])[0]


@query("SELECT doc_id, lower(path) NOT LIKE 'crates/gate/%' OR lower(path) LIKE 'crates/gate/s%' AS allowed FROM documents WHERE path IS NOT NULL")
def page_robots(spark, d):
    rules = pages.robots_rules("User-agent: *\nDisallow: /crates/gate/\nAllow: /crates/gate/s*\n")
    docs = table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", F.concat(F.lit("/"), F.lower("path")).alias("p"))
    return pages.allowed(docs, "p", rules).select("doc_id", "allowed")


@query("WITH RECURSIVE e AS (SELECT a.n_nationkey AS f, b.n_nationkey AS t FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey + 5, a.n_nationkey * 2)), r(k, depth) AS (SELECT CAST(1 AS INTEGER), 0 UNION SELECT e.t, r.depth + 1 FROM r JOIN e ON e.f = r.k WHERE r.depth < 3) SELECT CAST(k AS INTEGER) AS key, min(depth) AS depth FROM r GROUP BY 1")
def page_crawl(spark, d):
    a, b = table(spark, d, "nation").select(F.col("n_nationkey").alias("from_key")), table(spark, d, "nation").select(F.col("n_nationkey").alias("to_key"))
    steps = a.select("from_key", F.explode(F.array(F.col("from_key") + 5, F.col("from_key") * 2)).alias("s"))
    edges = steps.join(b, F.col("s") == F.col("to_key")).select("from_key", "to_key")
    return pages.crawl(spark.createDataFrame([(1,)], "key int"), edges, 3)


@query("SELECT s_suppkey, greatest(0, least(CAST(s_suppkey % 90 + 10 AS INTEGER), 60, 1500 - CAST(coalesce(sum(least(s_suppkey % 90 + 10, 60)) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER))) AS granted FROM supplier")
def page_budget(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 90 + 10).alias("n"))
    return pages.share_budget(s, "n", ["s_suppkey"], 60, 1500).select("s_suppkey", F.col("granted").cast("int").alias("granted"))


@query("SELECT doc_id, CASE WHEN length(text) <= 700 THEN CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in pages.WALLS.items()) + " END END AS wall FROM documents WHERE text IS NOT NULL")
def page_walls(spark, d):
    return pages.walls(table(spark, d, "documents").where("text IS NOT NULL"), "text").select("doc_id", "wall")


@query(None)
def page_blocks(spark, d):
    found = pages.blocks(table(spark, d, "documents"), "doc_id", "text")
    return pages.content_kind(found, "doc_id")


@query("""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, pos, list_filter(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+'), lambda w: w NOT IN (""" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + """)) AS w FROM b),
n AS (SELECT doc_id, pos, CAST(len(w) AS DOUBLE) AS l, CAST(len(list_filter(w, lambda x: x = 'ledger')) AS DOUBLE) AS n1, CAST(len(list_filter(w, lambda x: x = 'records')) AS DOUBLE) AS n2 FROM t),
s AS (SELECT *, count(*) OVER w AS a, avg(l) OVER w AS m, count(*) FILTER (WHERE n1 > 0) OVER w AS d1, count(*) FILTER (WHERE n2 > 0) OVER w AS d2 FROM n WINDOW w AS (PARTITION BY doc_id)),
f AS (SELECT *, d1 > 0 AND d1 * 2 < a OR d2 > 0 AND d2 * 2 < a AS rare FROM s),
i AS (SELECT *, CASE WHEN d1 > 0 AND NOT (rare AND d1 * 2 >= a) THEN ln(1 + (a - d1 + 0.5) / (d1 + 0.5)) ELSE 0 END AS i1, CASE WHEN d2 > 0 AND NOT (rare AND d2 * 2 >= a) THEN ln(1 + (a - d2 + 0.5) / (d2 + 0.5)) ELSE 0 END AS i2 FROM f),
r AS (SELECT doc_id, pos, CASE WHEN i1 + i2 > 0 THEN (i1 * n1 * 2.2 / (n1 + 1.2 * (0.25 + 0.75 * l / greatest(m, 1))) + i2 * n2 * 2.2 / (n2 + 1.2 * (0.25 + 0.75 * l / greatest(m, 1)))) * (CASE WHEN n1 > 0 THEN i1 ELSE 0 END + CASE WHEN n2 > 0 THEN i2 ELSE 0 END) / (i1 + i2) ELSE 0 END AS score FROM i),
o AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM r)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, round(score, 6) AS score FROM o WHERE best <= 0 OR score >= 0.15 * best""")
def page_focus(spark, d):
    """The paragraphs of every document that answer a query."""
    parts = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("p", "text"))
    found = parts.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "text")
    return pages.focus(found, "doc_id", "the records of a ledger").where("kept").select("doc_id", "pos", F.round("score", 6).alias("score"))


@query("SELECT doc_id, CAST(1 AS BIGINT) AS pos, 'type' AS kind, CAST(doc_id AS VARCHAR) AS id, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, '__STATE__', CAST(doc_id AS VARCHAR), source FROM documents WHERE doc_id % 2 = 1")
def page_scripts(spark, d):
    """Scripts of pages made of the documents: every other one assigns its state."""
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), "source"), {"ignoreNullFields": "false"})
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<p>a</p><script type='application/ld+json'> "), body, F.lit("</script><script>run({);</script>")))
    html = html.otherwise(F.concat(F.lit("<script>window.__STATE__ = "), body, F.lit(";</script><script type='application/json'>{cut</script>")))
    found = pages.script_json(table(spark, d, "documents").select("doc_id", html.alias("html"), "source"), "doc_id", "html")
    return found.select("doc_id", "pos", "kind", F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.source").alias("source"))


@query("SELECT doc_id, 'pages.example/' || lower(path) || '?id=' || doc_id AS key FROM documents WHERE path IS NOT NULL")
def page_url_keys(spark, d):
    url = F.concat(F.lit("HTTPS://WWW.Pages.example/"), "path", F.lit("/?utm_medium=x&id="), F.col("doc_id").cast("string"), F.lit("&gclid=1"))
    return table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", X.url_key(url).alias("key"))


@query("SELECT date_trunc('hour', ts) + INTERVAL (CAST(extract(minute FROM ts) AS BIGINT) // 15 * 15) MINUTE AS quarter, CAST(count(*) AS BIGINT) AS events_ FROM events GROUP BY 1")
def calendar_quarters(spark, d):
    return table(spark, d, "events").groupBy(S.calendar_floor(F.col("ts"), "minute", 15).cast("timestamp_ntz").alias("quarter")).agg(F.count(F.lit(1)).alias("events_"))


@query("SELECT event_id, CAST(v AS DOUBLE) AS v FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1.5' WHEN 1 THEN '-2' WHEN 2 THEN NULL ELSE NULL END AS v FROM events)")
def number_cells(spark, d):
    text = F.element_at(F.array(F.lit("1.5"), F.lit(" -2 "), F.lit("n/a"), F.lit("x1")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.number_of(text).alias("v"))
