import decimal
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.engine import dialect
from millrace.engine.catalog import Catalog, format_of, safe_join
from millrace.engine.page import cell, page, profile, read_cursor, write_cursor
from millrace.engine.sql import Refused, configure, gate, prepare, sentence
from millrace.sources import delimited, inline, jsons, names, typed


@pytest.fixture
def sql(spark):
    configure(spark)
    spark.createDataFrame([(1, 2.5, "x", [1, 2]), (7, None, "y", [])], "n long, f double, t string, a array<long>").createOrReplaceTempView("t")
    return spark


def rows(spark, q, **k):
    return page(spark, q, **k).rows


def test_dialect(sql):
    assert rows(sql, "SELECT n/2 AS h, f/2 AS g, 7/2 AS c, 2147483647+1 AS big, 1.5 AS d, a[1] AS one FROM t ORDER BY n") == [[0, 1.25, 3, 2147483648, 1.5, 1], [3, None, 3, 2147483648, 1.5, None]]
    assert rows(sql, "SELECT unnest(range(1, 4)) AS i") == [[1], [2], [3]]
    assert rows(sql, "SELECT unnest(range(3, 3)) AS i") == []
    assert rows(sql, "SELECT n FROM t ORDER BY n OFFSET 1 LIMIT 1") == [[7]]
    assert rows(sql, "SELECT to_date('05/06/2024', '%d/%m/%Y') AS d, CAST(18446744073709551615 AS BIGINT UNSIGNED) AS u, CAST(1 AS DECIMAL(5,2)) AS e") == [["2024-06-05", "18446744073709551615", "1.00"]]
    assert rows(sql, "SELECT sum(n) OVER (ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, 'a/b' AS t FROM t ORDER BY 1") == [[1, "a/b"], [8, "a/b"]]
    assert "element_at(x.y, 2)" in dialect.rewrite("SELECT x.y[2] FROM t")


@pytest.mark.parametrize(
    "q",
    ["DROP TABLE x", "INSERT INTO t VALUES (1)", "SELECT reflect('java.lang.System', 'exit')", "SELECT repeat('a', 100000000)", "EXPLAIN DROP TABLE t", "SET x=1", "SELECT 1; SELECT 2", "WITH a AS (SELECT java_method('x', 'y')) SELECT * FROM a",
     "SELECT n FROM t WHERE n IN (SELECT reflect('a', 'b'))", "SELECT * FROM csv.`/etc/passwd`", "CREATE TABLE q AS SELECT 1", "SELECT sequence(1, 30000000)", "", "SHOW TABLES"],
)
def test_gate_refuses(sql, q):
    with pytest.raises(Refused):
        prepare(sql, q)


def test_gate_lets_queries_through(sql):
    for q in ("SELECT 1", "EXPLAIN SELECT 1", "SELECT * FROM t WHERE n = (SELECT max(n) FROM t)", "SELECT t FROM t UNION SELECT 'z'", "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "SELECT n, rank() OVER (ORDER BY f) FROM t", "VALUES (1), (2)"):
        gate(sql, q)


def test_errors_are_sentences(sql):
    with pytest.raises(Exception) as x:
        rows(sql, "SELECT n / (n - n) FROM t")
    assert sentence(x.value).startswith("a number was divided by zero")


def test_orders(sql):
    assert prepare(sql, "SELECT n FROM t ORDER BY n DESC").order == "query"
    assert prepare(sql, "SELECT n FROM t WHERE n > 0").order == "file"
    assert prepare(sql, "SELECT t, count(*) AS k FROM t GROUP BY t").order == "columns"
    assert prepare(sql, "SELECT collect_list(a) AS x FROM t GROUP BY t").order == "none"
    assert rows(sql, "SELECT f, count(*) AS k FROM t GROUP BY f")[-1] == [None, 1]


def test_pages_join_to_the_whole(sql):
    q = "SELECT id, id % 7 AS g FROM range(500) GROUP BY id"
    whole = rows(sql, q, max_rows=1000, max_bytes=2_000_000)
    got, p = [], page(sql, q, max_rows=90)
    got += p.rows
    while p.next:
        p = page(sql, q, max_rows=90, cursor=p.next)
        got += p.rows
    assert got == whole and len(got) == 500
    q = "SELECT id, repeat('x', 50) AS pad FROM range(500) GROUP BY id"
    small = page(sql, q, max_bytes=4096, max_rows=1000)
    assert 0 < len(small.rows) < 100 and small.next
    with pytest.raises(Refused):
        page(sql, q, cursor=small.next, max_bytes=5000)
    with pytest.raises(Refused):
        page(sql, q, cursor=small.next[:-1] + ("0" if small.next[-1] != "0" else "1"), max_bytes=4096)


@given(st.integers(0, 2**64 - 1), st.integers(0, 10**12))
def test_cursor_round_trip(f, n):
    assert read_cursor(write_cursor(f, n), f) == n


def test_cells_lose_nothing():
    from pyspark.sql import types as T

    assert cell(2**60, T.LongType()) == str(2**60) and cell(5, T.LongType()) == 5
    assert cell(float("nan"), T.DoubleType()) == "NaN" and cell(0.1, T.FloatType()) == 0.1 and cell(decimal.Decimal("1.50"), T.DecimalType(5, 2)) == "1.50"
    assert cell(b"\x01\xff", T.BinaryType()) == "01ff" and cell([1, None], T.ArrayType(T.LongType())) == [1, None]


def test_profile(sql):
    got = {r["column"]: r for r in profile(sql.table("t")).collect()}
    assert (got["n"].min, got["n"].max, got["n"].mean, got["f"].nulls, got["a"].distinct) == ("1", "7", 4.0, 1, None)
    assert profile(sql.table("t").limit(0)).where("rows <> 0").count() == 0


VALUES = st.one_of(st.from_regex(r"-?[0-9]{1,20}", fullmatch=True), st.from_regex(r"-?[0-9]{1,3}\.[0-9]{1,3}", fullmatch=True), st.sampled_from(["true", "FALSE", "2024-01-31", "2024-02-30", "2024-01-01T10:00", "2024-01-01 10:00:00.5", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00+0130", "x", "", "+1", "01", "1e5", "1.", "NaN", "2024-1-1"]))


@settings(max_examples=25, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=60))
def test_classes_agree_with_python(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    from pyspark.sql import functions as F

    got = {r.i: r.c for r in df.select("i", typed.classes(F.col("x")).alias("c")).collect()}
    assert all(got[i] == (typed.classify(x) if x else None) for i, x in enumerate(xs)), [(x, got[i]) for i, x in enumerate(xs) if x and got[i] != typed.classify(x)]


def test_names():
    assert names.table_name("dir/Report 1.csv") == "Report_1" and names.table_name("2024.csv") == "t_2024"
    assert names.column_names(["a", "", "a", " b "]) == ["a", "column_2", "a_2", "b"]


def test_delimiters_and_headers():
    assert delimited.sniff_delimiter("a;b;c\n1;2,5;3\n") == ";" and delimited.sniff_delimiter("a\tb\n1\t2\n") == "\t"
    assert delimited.has_header([["a", "b"], ["1", "x"]]) and not delimited.has_header([["1", "b"], ["2", "c"]])


def test_json_types():
    m = lambda *vs: __import__("functools").reduce(jsons.merge, map(jsons._kind, vs))
    assert m(1, 2.5) == "float" and m(2**60, 1.5) == "text" and m(1, "x") == "text" and m([1], [2.5]) == ("list", "float") and m(None, True) == "bool"


def test_inline(spark):
    df, warned = inline.table(spark, [["18446744073709551615", "NaN"], {"big": 1}, [2, 3.5, 9]], [{"name": "big", "type": "uint64"}, {"name": "x", "type": "float64"}])
    assert [str(r.big) for r in df.collect()] == ["18446744073709551615", "1", "2"] and len(warned) == 1
    assert inline.table(spark, [], ["a"])[0].count() == 0


def test_catalog(spark, tmp_path):
    (tmp_path / "sales.csv").write_text('region,units,price,day\nnorth,10,1.5,2024-01-01\nsouth,,2.5,2024-01-02\n"ea, st",5,3,2024-01-03\n')
    (tmp_path / "zip.csv").write_text('zip;v\n02134;a\n10001;"b;c"\n')
    (tmp_path / "nulls.csv").write_text('a,b\n1,""\n2,\n3,x\n')
    (tmp_path / "e.ndjson").write_text('{"t":1,"kind":"x"}\n{"t":2,"kind":"y","z":[1]}\n')
    (tmp_path / "m.json").write_text('[{"v":1},{"v":"two"},{"v":[3]},{"w":{"a":1.5}}]')
    (tmp_path / "u16.csv").write_bytes("a,b\n1,é\n".encode("utf-16"))
    (tmp_path / "x.bin").write_bytes(b"\0\1")
    (tmp_path / ".hidden.csv").write_text("a\n1\n")
    os.symlink("/etc/hostname", tmp_path / "link.csv")
    c = Catalog.discover(spark, str(tmp_path))
    c.add("extra", [[10, "a"], [5, "b"]], ["k", "v"])
    assert sorted(c.specs) == ["e", "extra", "m", "nulls", "sales", "u16", "zip"] and len(c.notes) == 2
    assert c.query("SELECT region, units / 2 AS h FROM sales").rows == [["ea, st", 2], ["north", 5], ["south", None]]
    assert c.query("SELECT * FROM nulls").rows == [[1, ""], [2, None], [3, "x"]]
    assert c.query("SELECT zip FROM zip").rows == [["02134"], ["10001"]]
    assert c.query("SELECT * FROM u16").rows == [[1, "é"]]
    assert sorted(map(str, c.query("SELECT * FROM m").rows)) == ["['1', None]", "['[3]', None]", "['two', None]", "[None, {'a': 1.5}]"]
    assert c.query("SELECT s.region, x.v FROM sales s JOIN extra x ON x.k = s.units").rows == [["ea, st", "b"], ["north", "a"]]
    assert c.describe("sales")["columns"][1]["nulls"] == 1
    done = c.run({"sql": "SELECT a, b FROM nulls ORDER BY a", "output": "o.csv"})
    assert done["bytes"] == 16 and (tmp_path / "o.csv").read_text() == 'a,b\n1,""\n2,\n3,x\n'
    with pytest.raises(Refused):
        c.run({"sql": "SELECT 1", "output": "o.csv"})
    with pytest.raises(Refused):
        c.run({"sql": "SELECT 1", "output": "../o.csv"})
    assert c.run({"sql": "SELECT a FROM nulls", "output": "o.parquet"})["rows"] == 3 and format_of(tmp_path / "o.parquet") == "parquet"
    with pytest.raises(Refused):
        safe_join(str(tmp_path), "link.csv")
    with pytest.raises(Refused):
        c.run({"nonsense": 1})
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".") and f != ".hidden.csv"]


def test_floats_roots_and_unsigned_sums(spark):
    from millrace.engine import sql as Q

    Q.configure(spark)
    one = lambda s: Q.prepare(spark, s).df.first()[0]
    assert one("SELECT 1.5 / 0.0") == float("inf") and one("SELECT -1.5 / 0.0 * 2") == float("-inf") and one("SELECT 0.0 / 0.0") != one("SELECT 0.0 / 0.0")
    assert one("SELECT 1 + 3.0 / 2.0 - 0.5") == 2.0 and one("SELECT 6.0 * 2.0 / 3.0") == 4.0 and one("SELECT CAST(NULL AS DOUBLE) / 0.0") is None and one("SELECT 7 / 2") == 3
    assert one("SELECT abs(-3.0) / (SELECT 2.0)") == 1.5 and one("SELECT sum(x) / max(y) FROM (VALUES (1.0, 0.0), (2.0, 0.0)) AS t(x, y)") == float("inf")
    for bad in ("SELECT sqrt(-1)", "SELECT CAST(-1 AS BIGINT UNSIGNED)", "SELECT sum(CAST(x AS BIGINT UNSIGNED)) FROM (VALUES (18446744073709551615), (1)) AS t(x)", "SELECT 1 / 0"):
        with pytest.raises(Exception):
            one(bad)
    assert one("SELECT sqrt(16)") == 4 and one("SELECT approx_distinct(x) FROM (VALUES (1), (2), (2)) AS t(x)") == 2 and str(one("SELECT sum(CAST(x AS BIGINT UNSIGNED)) FROM (VALUES (18446744073709551614), (1)) AS t(x)")) == "18446744073709551615"
