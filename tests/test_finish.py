from pyspark.sql import functions as F

from millrace.operators import finish as N
from millrace.operators import search


def factors(spark, rows, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, url string, published string")
    return [round(r.f, 6) for r in df.select("i", make().alias("f")).orderBy("i").collect()]


def test_coverage(spark):
    texts = ["about a b-tree", "BTREE pages", "a binary tree", None, "the B tree of 5.2.1", "b-tree 5.5", "b-tree 15.2 and 5.20", "b-tree in 2023", "b-tree in 2023 and 2026", "b-tree x20231 5.2"]
    got = factors(spark, [(t, None, None) for t in texts], lambda: N.coverage_factor(F.col("title"), "B-tree v 5.2 2026!"))
    assert got == [1, 1, 0.3, 0.3, 1, 0.3, 0.3, 0.3, 1, 1]
    assert factors(spark, [("x", None, None)], lambda: N.coverage_factor(F.col("title"), "plain words 1-2")) == [1]
    # Another spelling of either version asked for is enough.
    assert factors(spark, [("python 3.11", None, None), ("python 3.9", None, None), ("python 2.7", None, None)], lambda: N.coverage_factor(F.col("title"), "3.12 vs 3.11")) == [1, 0.3, 1]


def test_authority(spark):
    rows = [("Ledger docs", "https://docs.one.example/a", None), ("Other", "https://one.example", None), ("ledger of x", "https://two.example/b", None), (None, None, None), ("a survey", "https://arxiv.org/1", None)]
    auth = lambda q, i="web", **k: lambda: N.authority_factor(F.col("title"), F.col("url"), F.col("published"), q, i, {"ledger": ("one.example",), "ledger book": ("two.example",)}, **k)
    assert factors(spark, rows, auth("ledger")) == [round(1.6 * 1.35, 6), 1.6, 1.35, 1, 1]
    assert factors(spark, rows, auth("ledger", "code")) == [round(1.8 * 1.35, 6), 1.8, 1.35, 1, 1]
    assert factors(spark, rows, auth("benchmark papers", "paper")) == [1, 1, 1, 1, round(1.35 * 0.65, 6)]
    days = [("t", None, d) for d in ("2025-03-10T08:00", "2025-03-08", "2025-03-04", "2025-02-20", "2024-01-01", "soon", None, "2025-03-12")]
    assert factors(spark, days, auth("qqq", "news", today="2025-03-10")) == [1.5, 1.3, 1.15, 1, 0.85, 1, 1, 1.5]


def test_intent():
    said = {"how to fix a leaking kitchen faucet": "web", "how to fix a rust crate": "code", "Ada Lovelace": "entity", "who is ada": "entity", "c++ vector": "code", "latest news": "news", "an arxiv paper on errors": "paper", "software wallpaper": "web", "": "web", "stack trace of x": "code"}
    assert {q: search.intent(q) for q in said} == said


def test_search_and_crawl(spark):
    engines = spark.createDataFrame([("a", "a", False), ("b", "b", False)], "engine string, family string, vertical boolean")
    hits = [("ledger", e, r, f"https://h{r}.example/{r}", f"ledger number {r}", "", None) for e in "ab" for r in range(10)] + [("none here", "a", 0, "https://q.example", "words", "", None)]
    out = N.search_finish(spark.createDataFrame(hits, "query string, engine string, rank int, url string, title string, snippet string, published string"), engines, ["ledger", "none here", "empty"], most=4, intent="web")
    got = out.results.collect()
    assert [(r["rank"], r.url) for r in sorted((r for r in got if r.query == "ledger"), key=lambda r: r["rank"])] == [(i + 1, f"https://h{i}.example/{i}") for i in range(4)]
    assert {r.query: r.weak for r in out.sets.collect()} == {"ledger": False, "none here": True, "empty": True}
    assert {(r.query, r.engine, r.healthy) for r in out.health.collect()} == {("ledger", "a", True), ("ledger", "b", True), ("none here", "a", False)}
    pages = [(1, "https://s.example/1", 0, 200, "x" * 50), (2, "https://s.example/2", 1, 500, None), (3, "https://s.example/3", 1, 200, None), (4, "https://s.example/4", 1, 200, "y" * 50), (5, "https://t.example/5", 1, 204, "")]
    df = spark.createDataFrame(pages, "place int, url string, depth int, status int, content string")
    found = spark.createDataFrame([("https://s.example/9",), ("https://s.example.org/9",), (None,)], "url string")
    c = N.crawl_finish(df, found, "https://S.example/", most_chars=80, per_page=60)
    assert [(r.url, len(r.content), r.complete) for r in c.pages.orderBy("url").collect()] == [("https://s.example/1", 50, True), ("https://s.example/4", 30, False)]
    assert [r.url for r in c.inventory.collect()] == [f"https://s.example/{i}" for i in (1, 2, 3, 4, 9)]
    assert tuple(c.state.first()) == (2, 80, False, "content_budget", False)
    none = N.crawl_finish(df.limit(0), found.limit(0), "https://s.example")
    assert tuple(none.state.first()) == (0, 0, False, "frontier_empty_no_evidence", False) and not none.pages.collect()
