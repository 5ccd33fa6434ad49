import pytest
from pyspark.sql import functions as F

from millrace.functions import formats
from millrace.functions import text as X
from millrace.operators import charts, pages, search
from millrace.streaming import jobs


def test_numbers_and_ticks():
    assert [formats.number(x, s) for x, s in ((1234.5, ",.1f"), (0.256, ".1%"), (12345, "~s"), (1.5, "~f"), (2.0, "d"), (float("nan"), "f"), (1e6, ".2~s"))] == ["1,234.5", "25.6%", "12.345k", "1.5", "2", "", "1M"]
    assert formats.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10] and formats.log_ticks(1, 1000) == [1, 10, 100, 1000] and formats.log_ticks(2, 8) == [2, 5]
    with pytest.raises(ValueError):
        formats.number(1, "q")


def test_codecs():
    assert formats.unquote_git_path('"a\\303\\251\\t.rs"') == "aé\t.rs" and formats.unquote_git_path("plain") == "plain"
    assert formats.diff_stat("3\t1\ta.rs\n-\t-\tb.png\n") == (2, 3, 1)
    parts, at = [], 0
    while at is not None:
        part, at = formats.slice_utf8("é\nab\ncdéf" * 5, at, 7)
        parts.append(part)
    assert "".join(parts) == "é\nab\ncdéf" * 5
    assert formats.probe("Aab xab", "AB") == [(1, "Aab xab"), (5, "Aab xab")]


def test_text_expressions(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("r")).first().r
    assert one("Crème Straße", X.unaccented) == "creme strasse"
    assert [one(w, X.stem) for w in ("queries", "boxes", "runs", "testing", "is", "class")] == ["query", "box", "run", "test", "is", "class"]
    assert one("alpha beta", lambda c: X.term_ratio(c, "the beta of gamma")) == 0.5


def test_weak(spark):
    r = spark.createDataFrame([(1, 1, "a", "b"), (2, 1, "c", "d")], "place long, families long, title string, snippet string")
    assert search.weak(r, "alpha").first().weak
    r = spark.createDataFrame([(i, 3, "alpha", "") for i in range(1, 10)], "place long, families long, title string, snippet string")
    assert not search.weak(r, "alpha").first().weak


def test_metadata():
    html = "<html><head><title> A\n page </title><meta name='author' content='Q'><meta property=\"og:site_name\" content=\"S\"></head><time datetime='2024-01-02'></html>"
    assert pages.metadata(html) == {"title": "A page", "byline": "Q", "published": "2024-01-02", "site": "S"}
    assert pages.charset("é".encode("latin-1")) == "windows-1252" and pages.charset(b"<meta charset='iso-8859-2'>") == "iso8859-2" and pages.charset(b"x") == "utf-8"


def test_chart_requests(spark):
    df = spark.createDataFrame([("a", 1.0, "s"), ("b", 3.0, "s"), ("a", 2.0, "t")], "k string, v double, s string")
    assert {r.category: r.total for r in charts.chart(df, {"kind": "totals", "x": "k", "y": "v"}).collect()} == {"a": 3.0, "b": 3.0}
    assert charts.chart(df, {"kind": "stack", "x": "k", "y": "v", "series": "s"}).count() == 3
    for bad in ({"kind": "tree"}, {"kind": "pie", "x": "zz", "y": "v"}, {"kind": "pie", "colour": 1}):
        with pytest.raises(ValueError):
            charts.chart(df, bad)


def test_jobs(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "s.csv").write_text("a,b\n1,x\n2,y\n")
    batch = spark.createDataFrame([("r1", str(data), None, "SELECT a FROM s ORDER BY a", None, 1, None), ("r2", str(data), "tables", None, None, None, None), ("r3", str(data), None, "DROP TABLE s", None, None, None), ("r1", str(data), None, "SELECT 9", None, None, None)], jobs.JOB)
    handle = jobs.handler(str(tmp_path / "out"))
    handle(batch, 0)
    handle(batch, 0)
    results = {r.run_id: r for r in spark.read.parquet(str(tmp_path / "out" / "results")).collect()}
    assert set(results) == {"r1", "r2", "r3"} and results["r3"].error and '"next": "dt1.' in results["r1"].result
    assert [(r.run_id, r["values"]) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()] == [("r1", "[1]")]
    assert [r.name for r in spark.read.parquet(str(tmp_path / "out" / "tables")).collect()] == ["s"]


def test_images_in_windows_and_regions(spark):
    import struct

    import numpy as np

    from millrace.operators import images

    pnm = lambda a: b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 200, (100, 120))
    b = a.copy()
    b[3:7, 5:9] += 50
    b[60:64, 80:110] += 50
    df = spark.createDataFrame([(1, pnm(a), pnm(b)), (2, pnm(a), pnm(a)), (3, pnm(a), None), (4, b"xx", pnm(a)), (5, pnm(a), pnm(a[:50]))], "i int, x binary, y binary")
    got = {r.i: r for r in images.differences(df, "i", "x", "y").collect()}
    assert [(r.left, r.top, r.right, r.bottom, r.pixels) for r in got[1].regions] == [(80, 60, 110, 64, 120), (5, 3, 9, 7, 16)]
    assert abs(got[1].changed - 136 / 12_000) < 1e-12 and 0.8 < got[1].ssim < 0.999 and got[2].ssim > 1 - 1e-9 and got[2].regions == []
    assert got[3].error == "an image is missing" and got[4].error and "size" in got[5].error and len(got) == 5
    x, y = a[20:28, 20:28].astype(float), b[20:28, 20:28] * 0.5
    c = ((x - x.mean()) * (y - y.mean())).mean()
    want = (2 * x.mean() * y.mean() + 6.5025) * (2 * c + 58.5225) / ((x.mean() ** 2 + y.mean() ** 2 + 6.5025) * (x.var() + y.var() + 58.5225))
    assert abs(images.similarity(x, y) - want) < 1e-9
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 400) + b"\x03"
    sizes = spark.createDataFrame([(1, pnm(a)), (2, b"GIF89a" + struct.pack("<HH", 7, 9)), (3, jpeg), (4, b"\xff\xd8\xff"), (5, b""), (6, None)], "i int, x binary")
    assert [tuple(r) for r in images.geometry(sizes, "i", "x", 100).orderBy("i").collect()] == [(1, "pnm", 120, 100, 100, 83), (2, "gif", 7, 9, 7, 9), (3, "jpeg", 400, 30, 100, 8), (4, None, None, None, None, None), (5, None, None, None, None, None)]
