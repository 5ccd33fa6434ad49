"""Relational queries over the star schema, each with the SQL it is checked against.

Keys and counts are bigint, figures rounded doubles on both sides, and every top-k has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.engine.session import table
from millrace.functions import scalars as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def n(c: str = "*") -> Column:
    return F.count(F.lit(1) if c == "*" else F.col(c)).cast("long")


def r(c: Column, places: int = 4) -> Column:
    return F.round(c, places)


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


# --------------------------------------------------------------------------- projection, filter, predicates


@query("SELECT r.r_name AS region, CAST(count(DISTINCT o.o_orderkey) AS BIGINT) AS orders, CAST(round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS DOUBLE) AS revenue FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name")
def region_revenue(spark, d):
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(revenue()).alias("rev"))
    o = table(spark, d, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(n().alias("orders"), F.sum("rev").alias("rev"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.sum("orders").alias("orders"), r(F.sum("rev"), 2).alias("revenue"))


@query("SELECT l_orderkey AS k, l_quantity AS q, l_quantity AS q2, l_extendedprice * (1 + l_tax) AS taxed, CAST(1 AS BIGINT) AS one, 'x' AS tag FROM lineitem WHERE l_quantity >= 45 AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_discount <> 0.05")
def project_filter(spark, d):
    l = table(spark, d, "lineitem").where((F.col("l_quantity") >= 45) & (F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00'")) & (F.col("l_discount") != 0.05))
    q = F.col("l_quantity")
    return l.select(F.col("l_orderkey").alias("k"), q.alias("q"), q.alias("q2"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("taxed"), F.lit(1).cast("long").alias("one"), F.lit("x").alias("tag"))


@query("SELECT doc_id, source, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS size_class FROM documents WHERE lang IN ('de', 'fr', 'es') OR lang IS NULL")
def case_in_null(spark, d):
    c = F.col("n_chars")
    size = F.when(c.isNull(), "unknown").when(c < 500, "short").when(c < 2000, "middle").otherwise("long")
    return table(spark, d, "documents").where(F.col("lang").isin("de", "fr", "es") | F.col("lang").isNull()).select("doc_id", "source", size.alias("size_class"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type NOT LIKE 'PROMO%' AND p_size BETWEEN 10 AND 20")
def like_between(spark, d):
    return table(spark, d, "part").where(F.col("p_name").like("%a%e%") & ~F.col("p_type").like("PROMO%") & F.col("p_size").between(10, 20)).select("p_partkey", "p_name")


@query("SELECT CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS DOUBLE) AS dbl, CAST(CAST(o_orderkey AS DECIMAL(20, 0)) AS VARCHAR) AS txt, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 7 < 0 OR o_orderstatus = 'F' AND o_totalprice = floor(o_totalprice) OR o_orderpriority LIKE '1%'")
def casts(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").where(((k % 7) < 0) | ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") == F.floor("o_totalprice"))) | F.col("o_orderpriority").like("1%"))
    return o.select(F.floor("o_totalprice").alias("whole"), k.cast("double").alias("dbl"), k.cast("decimal(20,0)").cast("string").alias("txt"), F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT CAST(v AS BIGINT) AS v, w FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'c')) AS t(v, w) WHERE v IS NOT NULL OR w = 'c'")
def values_table(spark, d):
    return spark.sql("SELECT CAST(v AS BIGINT) AS v, w FROM VALUES (1, 'a'), (2, 'b'), (NULL, 'c') AS t(v, w) WHERE v IS NOT NULL OR w = 'c'")


# --------------------------------------------------------------------------- joins


@query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 300000")
def join_inner(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    c, na = table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(na, F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c.c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey")
def join_left(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(n().alias("orders"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT s.s_nationkey AS supplier_nation, c.c_nationkey AS customer_nation, CAST(coalesce(s.k, 0) AS BIGINT) AS suppliers, CAST(coalesce(c.k, 0) AS BIGINT) AS customers FROM (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS k FROM customer WHERE c_acctbal < 0 GROUP BY 1) c ON c.c_nationkey = s.s_nationkey")
def join_full(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(n().alias("a"))
    c = table(spark, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(n().alias("b"))
    j = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "outer")
    return j.select(F.col("s_nationkey").alias("supplier_nation"), F.col("c_nationkey").alias("customer_nation"), F.coalesce("a", F.lit(0)).alias("suppliers"), F.coalesce("b", F.lit(0)).alias("customers"))


@query("SELECT n.n_name, s.s_name FROM supplier s RIGHT JOIN nation n ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 9000")
def join_right(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 9000")
    return s.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "right").select("n_name", "s_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority LIKE '1%')")
def join_anti(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderpriority").like("1%")).select("o_custkey")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    a, b = (table(spark, d, "nation").alias(x) for x in "ab")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("other"))


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice > 0.8 * o.o_totalprice")
def join_residual(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return l.join(o, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_extendedprice") > 0.8 * F.col("o_totalprice"))).select("l_orderkey", "l_linenumber")


@query("SELECT r.r_name AS a, s.lo FROM region r JOIN (VALUES (CAST(0 AS BIGINT)), (2), (4)) s(lo) ON r.r_regionkey >= s.lo")
def join_theta(spark, d):
    """A condition without an equality; the one side is five rows, the other three."""
    lo = spark.createDataFrame([(0,), (2,), (4,)], "lo long")
    return table(spark, d, "region").join(lo, F.col("r_regionkey") >= F.col("lo")).select(F.col("r_name").alias("a"), "lo")


@query("SELECT o.o_orderpriority AS o_orderpriority, t.rank AS rank, CAST(count(*) AS BIGINT) AS orders FROM orders o JOIN (VALUES ('1-URGENT', CAST(1 AS BIGINT)), ('2-HIGH', 2), ('5-LOW', 5)) t(o_orderpriority, rank) USING (o_orderpriority) GROUP BY ALL")
def join_inline(spark, d):
    t = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("5-LOW", 5)], "o_orderpriority string, rank long")
    return table(spark, d, "orders").join(t, "o_orderpriority").groupBy("o_orderpriority", "rank").agg(n().alias("orders"))


# --------------------------------------------------------------------------- subqueries


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
def scalar_subquery(spark, d):
    o = table(spark, d, "orders")
    o.createOrReplaceTempView("millrace_orders")
    return spark.sql("SELECT o_orderkey FROM millrace_orders WHERE o_totalprice > (SELECT 1.5D * avg(o_totalprice) FROM millrace_orders)")


@query("SELECT c.c_custkey, (SELECT CAST(round(max(o.o_totalprice), 2) AS DOUBLE) FROM orders o WHERE o.o_custkey = c.c_custkey) AS largest FROM customer c")
def correlated_subquery(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(r(F.max("o_totalprice"), 2).alias("largest"))
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "largest")


@query("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS k FROM big GROUP BY 1) SELECT o_custkey, CAST(k AS BIGINT) AS k FROM per WHERE k >= 2")
def cte_chain(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 200000")
    return big.groupBy("o_custkey").agg(n().alias("k")).where("k >= 2")


@query("WITH RECURSIVE t(i) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT i * 2 FROM t WHERE i < 1000) SELECT i FROM t")
def cte_recursive(spark, d):
    return spark.sql("WITH RECURSIVE t(i) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT i * 2 FROM t WHERE i < 1000) SELECT i FROM t")


@query("SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def lateral_top(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return o.join(table(spark, d, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")


# --------------------------------------------------------------------------- aggregation


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2")
def group_by(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum(revenue()), 2).alias("revenue"), r(F.avg("l_discount"), 6).alias("avg_disc"), n().alias("lines"))


@query("SELECT CAST(count(*) AS BIGINT) AS k, sum(l_quantity) AS s, max(l_shipdate) AS m FROM lineitem WHERE l_quantity < 0")
def global_empty(spark, d):
    return table(spark, d, "lineitem").where("l_quantity < 0").agg(n().alias("k"), F.sum("l_quantity").alias("s"), F.max("l_shipdate").alias("m"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS k FROM orders GROUP BY 1 HAVING count(*) > 12 AND min(o_totalprice) < 50000")
def having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(n().alias("k"), F.min("o_totalprice").alias("m")).where("k > 12 AND m < 50000").drop("m")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS rows_, CAST(count(value) AS BIGINT) AS with_value, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def count_forms(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(n().alias("rows_"), n("value").alias("with_value"), F.countDistinct("user_id").cast("long").alias("users"))


@query("SELECT min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, round(avg(o_totalprice), 4) AS mean_price, CAST(sum(CAST(o_orderkey AS HUGEINT)) AS BIGINT) AS key_sum FROM orders")
def agg_dates_sum(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"), r(F.avg("o_totalprice")).alias("mean_price"), F.sum("o_orderkey").alias("key_sum"))


@query("SELECT n_regionkey, list_sort(array_agg(n_name)) AS nations, list_sort(array_agg(n_name) FILTER (WHERE n_nationkey > 10)) AS late_nations, string_agg(n_name, '; ' ORDER BY n_name) AS listed FROM nation GROUP BY 1")
def array_string_agg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list("n_name")).alias("nations"),
        F.expr("nullif(sort_array(collect_list(n_name) FILTER (WHERE n_nationkey > 10)), array())").alias("late_nations"),
        F.expr("listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name)").alias("listed"),
    )


@query("SELECT p_brand, median(p_retailprice) AS med, round(stddev_samp(p_retailprice), 6) AS sd, round(var_pop(p_retailprice), 6) AS vp, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(corr(p_size, p_retailprice), 6) AS rho, round(covar_samp(p_size, p_retailprice), 6) AS cov, round(regr_slope(p_retailprice, p_size), 6) AS slope FROM part GROUP BY 1")
def statistics(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.median(p).alias("med"), r(F.stddev_samp(p), 6).alias("sd"), r(F.var_pop(p), 6).alias("vp"), r(F.percentile(p, 0.25), 6).alias("q1"),
        r(F.corr("p_size", p), 6).alias("rho"), r(F.covar_samp("p_size", p), 6).alias("cov"), r(F.regr_slope(p, F.col("p_size")), 6).alias("slope"),
    )


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(spark, d):
    return table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS k FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("long").alias("g"), n().alias("k"))


@query("SELECT n_regionkey, n_nationkey, CAST(count(*) AS BIGINT) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(n().alias("k"))
    return table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.sum("k").alias("k"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS k FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    return table(spark, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(n().alias("k"))


@query("SELECT * FROM (SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS \"F\", CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS \"O\" FROM orders GROUP BY 1)")
def pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(n()).na.fill(0, ["F", "O"])


# --------------------------------------------------------------------------- set operations, order, limits


@query("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def union_distinct(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).union(table(spark, d, "region").select("r_regionkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity < 3 INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity > 49")
def intersect_all(spark, d):
    l = table(spark, d, "lineitem")
    return l.where("l_quantity < 3").select(F.col("l_suppkey").alias("k")).intersectAll(l.where("l_quantity > 49").select("l_suppkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def except_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_all(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, d, "customer").select("c_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars ASC NULLS FIRST, doc_id LIMIT 10 OFFSET 5")
def offset_limit(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.asc_nulls_first("n_chars"), "doc_id").offset(5).limit(10)


# --------------------------------------------------------------------------- windows


@query("SELECT c_custkey, c_mktsegment, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC NULLS LAST) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC NULLS LAST) AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
def window_ranks(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    v = Window.partitionBy("c_mktsegment").orderBy(F.desc_nulls_last("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("rk"), F.dense_rank().over(v).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("SELECT s_suppkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
def window_shares(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", r(F.percent_rank().over(w), 6).alias("pr"), r(F.cume_dist().over(w), 6).alias("cd"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING), 4) AS running, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS total, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth FROM lineitem")
def window_sums(spark, d):
    p = Window.partitionBy("l_orderkey")
    w = p.orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    q = "l_quantity"
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(F.sum(q).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("running"), r(F.sum(q).over(p)).alias("total"), r(F.avg(q).over(w.rowsBetween(-1, 1))).alias("smooth"))


@query("SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_orderkey, 2) OVER w AS after2, first_value(o_totalprice) OVER w AS first_price, nth_value(o_totalprice, 2) OVER w AS second_price, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_offsets(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("after2"), F.first("o_totalprice").over(w).alias("first_price"),
        F.nth_value("o_totalprice", 2).over(w).alias("second_price"), F.last("o_orderkey").over(whole).alias("last_key"),
    )


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour FROM events")
def window_range(spark, d):
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s")
    return table(spark, d, "events").select("event_id", "user_id", seconds).select("event_id", F.count(F.lit(1)).over(w).cast("long").alias("last_hour"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_per_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select(F.col("m.event_id").alias("event_id"), "user_id")


@query("SELECT user_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS events_, min(ts) AS begun FROM (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY 1, 2")
def gap_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.lag("ts").over(w) >= F.col("ts") - F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    e = table(spark, d, "events").select("user_id", "ts", "event_id", gap.alias("gap"))
    return e.withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).groupBy("user_id", "island").agg(n().alias("events_"), F.min("ts").alias("begun"))


# --------------------------------------------------------------------------- scalar functions


@query("SELECT c_custkey, upper(c_name) AS u, substr(c_name, 1, 4) AS s, CAST(length(c_name) AS BIGINT) AS len, trim('  ' || c_mktsegment || ' ') AS t, concat(c_mktsegment, '-', c_custkey) AS c, replace(c_mktsegment, 'I', 'i') AS rep, CAST(position('U' IN c_mktsegment) AS BIGINT) AS pos, reverse(c_mktsegment) AS rev, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, repeat('ab', 2) AS twice, split_part(c_name, '#', 2) AS part2, translate(c_mktsegment, 'AEIOU', '*****') AS tr, CAST(levenshtein(c_mktsegment, 'MACHINERY') AS BIGINT) AS lev, starts_with(c_mktsegment, 'B') AS b FROM customer")
def string_functions(spark, d):
    m, c = F.col("c_mktsegment"), F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(c).alias("u"), F.substring(c, 1, 4).alias("s"), F.length(c).cast("long").alias("len"), F.trim(F.concat(F.lit("  "), m, F.lit(" "))).alias("t"),
        F.concat(m, F.lit("-"), F.col("c_custkey").cast("string")).alias("c"), F.replace(m, F.lit("I"), F.lit("i")).alias("rep"), F.instr(m, "U").cast("long").alias("pos"), F.reverse(m).alias("rev"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("lp"), F.rpad(m, 12, ".").alias("rp"), F.repeat(F.lit("ab"), 2).alias("twice"), F.split_part(c, F.lit("#"), F.lit(2)).alias("part2"),
        F.translate(m, "AEIOU", "*****").alias("tr"), F.levenshtein(m, F.lit("MACHINERY")).cast("long").alias("lev"), F.startswith(m, F.lit("B")).alias("b"),
    )


@query("SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has3, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS caps, regexp_replace(text, '[^a-z]+', '_', 'g') AS squeezed, regexp_extract(path, '([a-z]+)$', 1) AS ext FROM documents WHERE text IS NOT NULL")
def regex_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select(
        "doc_id", F.regexp_like(t, F.lit("[0-9]{3}")).alias("has3"), F.regexp_count(t, F.lit("[A-Z][a-z]+")).cast("long").alias("caps"),
        F.regexp_replace(t, "[^a-z]+", "_").alias("squeezed"), F.regexp_extract("path", "([a-z]+)$", 1).alias("ext"),
    )


@query("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age, strftime(o_orderdate, '%d/%m/%Y') AS shown FROM orders")
def date_functions(spark, d):
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.year(o).cast("long").alias("y"), F.month(o).cast("long").alias("m"), F.day(o).cast("long").alias("d"), F.date_trunc("month", o).cast("date").alias("mon"), F.date_trunc("week", o).cast("date").alias("wk"),
        F.date_add(o.cast("date"), 30).alias("due"), F.date_diff(o.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("age"), F.date_format(o, S.date_pattern("%d/%m/%Y")).alias("shown"),
    )


@query("SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, round(sqrt(l_quantity), 6) AS sq, round(ln(l_extendedprice), 6) AS lg, round(power(l_discount, 2), 6) AS pw, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_extendedprice) AS BIGINT) AS ce, l_orderkey % 7 AS md, l_orderkey // 7 AS dv, greatest(l_tax, l_discount) AS hi, coalesce(nullif(l_tax, 0), -1) AS tax_or FROM lineitem")
def math_functions(spark, d):
    q, p, k = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(-q).alias("a"), r(S.checked_sqrt(q), 6).alias("sq"), r(F.ln(p), 6).alias("lg"), r(F.pow("l_discount", F.lit(2)), 6).alias("pw"), F.floor(p).alias("fl"), F.ceil(p).alias("ce"),
        (k % 7).alias("md"), F.expr("l_orderkey div 7").alias("dv"), F.greatest("l_tax", "l_discount").alias("hi"), F.coalesce(F.nullif(F.col("l_tax"), F.lit(0.0)), F.lit(-1.0)).alias("tax_or"),
    )


@query("SELECT CASE WHEN l_discount = 0 THEN CASE WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END ELSE l_tax / l_discount END > 1 AS over_one, CAST(count(*) AS BIGINT) AS k FROM lineitem GROUP BY 1")
def float_division(spark, d):
    return table(spark, d, "lineitem").groupBy((S.fdiv(F.col("l_tax"), F.col("l_discount")) > 1).alias("over_one")).agg(n().alias("k"))


@query("SELECT vec_id, embedding[1] AS first_, embedding[len(embedding)] AS last_, CAST(len(embedding) AS BIGINT) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2 FROM embeddings")
def array_functions(spark, d):
    e = F.col("embedding")
    norm = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.element_at(e, 1).alias("first_"), F.element_at(e, -1).alias("last_"), F.cardinality(e).cast("long").alias("dims"), r(norm).alias("norm2"))


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def unnest(spark, d):
    """A row for every element of every vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    return e.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), "x")


@query("SELECT n_nationkey, {'name': n_name, 'region': n_regionkey}['name'] AS name, CAST(n_nationkey + 1 AS BIGINT) AS up FROM nation")
def struct_field(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).getField("name").alias("name"), (F.col("n_nationkey") + 1).cast("long").alias("up"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_field(spark, d):
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
