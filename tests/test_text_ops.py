import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import images, pages, review, scan, search


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_url_keys(spark):
    k = lambda u: one(spark, u, X.url_key)
    assert k("https://www.Example.com/A/index.html?utm_source=x&b=1&fbclid=2") == "example.com/a?b=1"
    assert k("http://example.com/") == "example.com" and k("Not A Url") == "not a url" and one(spark, "https://www.a.org/x", X.host) == "a.org"


def test_near_identical_and_language(spark):
    df = spark.createDataFrame([("The quick brown fox jumps 12", "the quick brown fox jumps, 99"), ("abc def", "xyz uvw")], "a string, b string")
    assert [r.r for r in df.select(X.near_identical(F.col("a"), F.col("b")).alias("r")).collect()] == [True, False]
    for text, lang in (("the cat and the dog of this house", "en"), ("der Hund und die Katze ist nicht da", "de"), ("le chat est dans la maison des voisins", "fr"), ("el perro por la casa de los vecinos con una", "es"), ("これは日本語です", "ja"), ("Привет мир как дела", "ru"), ("x", None)):
        assert one(spark, text, X.language) == lang, text


def test_robots_rules(spark):
    df = spark.createDataFrame([("/a/b.pdf", "/a/*.pdf$"), ("/a/b.pdfx", "/a/*.pdf$"), ("/private/x", "/private"), ("/pub", "/private"), ("/a+b", "/a+b")], "p string, r string")
    assert [r.m for r in df.select(X.rule_matches(F.col("r"), F.col("p")).alias("m")).collect()] == [True, False, True, False, True]
    rules = pages.robots_rules("User-agent: *\nDisallow: /a\nAllow: /a/b # c\n\nUser-agent: bot\nDisallow: /")
    got = pages.allowed(spark.createDataFrame([("/a/x",), ("/a/b/c",), ("/z",)], "p string"), "p", rules).collect()
    assert [r.allowed for r in got] == [False, True, True]


def test_fusion(spark):
    hits = spark.createDataFrame([("bing", 0, "https://a.com/x", "A page", "s"), ("ddg", 5, "http://www.a.com/x/", "A", "longer"), ("brave", 1, "https://a.com/x?utm_source=1", "A page", ""), ("arxiv", 0, "https://b.org/y", "B", ""), ("bing", 1, "https://c.com/1", "C1", ""), ("bing", 2, "https://c.com/2", "C2", ""), ("bing", 3, "https://c.com/3", "C3", ""), ("brave", 9, "https://d.com/1", "C1", "")], "engine string, rank int, url string, title string, snippet string").withColumn("published", F.lit(None).cast("string"))
    engines = spark.createDataFrame([("bing", "bing", False), ("ddg", "bing", False), ("brave", "brave", False), ("arxiv", "arxiv", True)], "engine string, family string, vertical boolean")
    got = search.fuse(hits, engines).orderBy("place").collect()
    assert got[0].key == "a.com/x" and got[0].families == 2 and abs(got[0].score - (1 / 61 + 1 / 62) * 1.5) < 1e-12 and got[0].snippet == "longer"
    assert [r.key for r in got].index("c.com/3") == len(got) - 1 and "d.com/1" not in [r.key for r in got]
    b = next(r for r in got if r.key == "b.org/y")
    assert abs(b.score - 0.6 / 61 * 0.4) < 1e-12
    assert search.fuse(hits.limit(0), engines).count() == 0 and search.intent("how to fix npm error") == "code"


def test_scan(spark):
    text = 'let a = 1;\nlet api_key = "sk_live_ABCDEF1234567890"; let token = "AAAAAAAAAAAAAAAAAAAA";\nuse md5::x; .join(&user_path)\n'
    found = scan.find(text, "src/a.rs")
    assert [(f[0], f[2]) for f in found] == [("secrets-exposure", 2), ("insecure-crypto", 3), ("path-traversal", 3)]
    df = spark.createDataFrame([("a.rs", text), ("b.py", text), ("c.rs", None), (None, text)], "path string, content string")
    c = scan.candidates(df)
    assert c.count() == 5 and {r.slug: (r.matches, r.tier) for r in scan.slug_counts(c).collect()}["insecure-crypto"] == (2, "precise")
    p = scan.payload(c, 350).orderBy("place").collect()
    assert p[0].shown and not p[1].shown and p[1].text == "- b.py: 2 matches"


def test_review(spark):
    cand = spark.createDataFrame([("l", 1, "a", "p", "1", 90, "Critical"), ("l", 2, "a", "p", "2", 95, "Major"), ("l", 3, "b", "q", "1", 99, "Minor"), ("l", 4, "c", "p", "1", 80, "Minor"), ("l", 5, "d", "p", "3", 79, "Minor"), ("l", 6, "e", "p", "4", 99, "Minor"), ("l", 7, "f", "p", "5", 99, "Minor")], "lens string, seq int, slug string, path string, line string, confidence int, severity string")
    chosen = review.select(cand, spark.createDataFrame([("p",)], "path string"))
    assert sorted(r.finding_id for r in chosen.collect()) == ["l:a", "l:c", "l:e"]
    v = spark.createDataFrame([("l:a", 1, "confirmed", 90, "seen"), ("l:a", 2, "refuted", 90, ""), ("l:c", 1, "confirmed", 90, " ")], "finding_id string, seq int, verdict string, confidence int, evidence string")
    n = review.counts(review.verify(chosen, v)).first()
    assert tuple(n) == (1, 0, 2, 1)
    assert {(r.path, r.line): r.findings for r in review.group(chosen).collect()}[("p", "1")] == ["l:a", "l:c"]


def test_blocks_links_feeds(spark):
    html = "<body><nav>Menu</nav><h1>Top</h1><p>One <b>two</b></p><h2>Sub</h2><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>x = 1\ny</pre><p>One</p><p>One</p><script>bad()</script></body>"
    got = pages.blocks_of(html)
    assert [(k, t) for _, k, _, t, _ in got] == [("heading", "Top"), ("para", "One two"), ("heading", "Sub"), ("list", "a"), ("list", "b"), ("table", "1 | 2"), ("code", "x = 1\ny"), ("para", "One")]
    assert got[3][4] == "Top > Sub"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    assert pages.blocks(df, "id", "html").count() == 8
    assert pages.sitemap_entries("<urlset><url><loc> http://a/ </loc><priority>0.5</priority></url></urlset>") == [("http://a/", None, 0.5, False)]
    assert pages.feed_items("<rss><channel><item><title>t</title><link>u</link><pubDate>d</pubDate></item></channel></rss>") == [("t", "u", "d")]


def test_blocks_of_markup_that_no_section_is_named_in(spark):
    odd = ["a <![]+4> b", "a <![x y> b", "a <![ifx[> b", "a <!x> b"]
    assert [[t for *_, t, _ in pages.blocks_of(h)] for h in odd] == [["a b"]] * 4
    # Without an end it is text; sections of known names, and numbers of any length, are read as before.
    texts = lambda h: [t for *_, t, _ in pages.blocks_of(h)]
    assert texts("a <![+4 b") == ["a <![+4 b"] and texts("a <![CDATA[ x > y ]]> b") == ["a b"] and texts("<![if !IE]> c <![endif]>") == ["c"]
    assert texts("x&#" + "9" * 5_000 + ";y&#" + "0" * 5_000 + "65;") == ["x\ufffdyA"]
    df = spark.createDataFrame(list(enumerate([*odd, None, "<p>c"])), "id int, html string")
    assert sorted((r.id, r.text) for r in pages.blocks(df, "id", "html").collect()) == [(0, "a b"), (1, "a b"), (2, "a b"), (3, "a b"), (5, "c")]


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a")], "from_key string, to_key string")
    got = {r.key: r.depth for r in pages.crawl(spark.createDataFrame([("a",)], "key string"), edges, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert pages.crawl(spark.createDataFrame([("a",)], "key string"), edges, 5, 3).count() == 3
    granted = pages.share_budget(spark.createDataFrame([(1, 50), (2, 90), (3, 90)], "i int, n int"), "n", ["i"], 80, 150).orderBy("i").collect()
    assert [r.granted for r in granted] == [50, 80, 20]


def png(a):
    import struct

    raw = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (64, 64))
    b = np.clip(a + 3, 0, 255)
    df = spark.createDataFrame([(1, png(a)), (2, png(b)), (3, png(a.T.copy())), (4, b"nope"), (5, None)], "i int, data binary")
    h = {r.i: r for r in images.hashes(df, "i", "data").collect()}
    assert len(h) == 4 and h[4].error and bin((h[1].dhash ^ h[2].dhash) & (2**64 - 1)).count("1") <= 10 < bin((h[1].phash ^ h[3].phash) & (2**64 - 1)).count("1")
    d = images.difference(png(a), png(np.where(np.arange(64)[:, None] == 5, 255 - a, a)))
    assert d["box"][1] == 5 and 0 < d["changed"] < 0.02 and images.difference(png(a), png(a))["ssim"] > 0.999
    assert images.palette(np.array([[[0, 0, 0], [250, 0, 0], [250, 0, 0], [0, 0, 0]]]), 2) == [((0, 0, 0), 2), ((250, 0, 0), 2)]
