import math
import random

import pytest

from millrace.operators import charts as C


def points(spark, rows):
    return spark.createDataFrame(rows, "s string, x double, y double")


def walk(p, most):
    """Largest triangles over all points of the buckets, one after the other."""
    p = sorted(p)
    n = len(p)
    if n <= most:
        return p
    bucket = {}
    for i, q in enumerate(p):
        b = -1 if i == 0 else most - 2 if i == n - 1 else (i - 1) * (most - 2) // (n - 2)
        bucket.setdefault(b, []).append(q)
    keys, at, out = sorted(bucket), p[0], [p[0]]
    for b, c in zip(keys[1:], keys[2:]):
        cx, cy = (sum(q[k] for q in bucket[c]) / len(bucket[c]) for k in (0, 1))
        at = max(bucket[b], key=lambda q: abs((at[0] - cx) * (q[1] - at[1]) - (at[0] - q[0]) * (cy - at[1])))
        out.append(at)
    return [*out, p[-1]]


def test_downsample_is_the_plain_walk(spark):
    rng = random.Random(2)
    rows = [("a", float(i), rng.gauss(0, 1) + math.sin(i / 30)) for i in range(3000)] + [("b", float(i), 1.0) for i in range(5)] + [("a", None, 1.0), ("a", 1.0, float("nan"))]
    got = C.downsample(points(spark, rows), "x", "y", 60, "s").collect()
    plain = walk([(x, y) for s, x, y in rows if s == "a" and x is not None and y == y], 60)
    have = {(r.x, r.y) for r in got if r.series == "a"}
    assert set(plain) <= have and len(have) <= 62
    assert len([r for r in got if r.series == "b"]) == 5


def test_box_and_histogram(spark):
    v = spark.createDataFrame([(float(x),) for x in [*range(1, 10), 30, -20]] + [(None,), (float("nan"),)], "v double")
    b = C.box(v, "v").first()
    assert (b.n, b.q1, b.median, b.q3, b.low, b.high, b.outliers) == (11, 2.5, 5.0, 7.5, 1.0, 9.0, 2)
    h = C.histogram(v, "v", 5).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 11 and h[0].low == -20 and h[-1].high == 30 and h[-1]["count"] == 1
    assert C.histogram(v.limit(0), "v").count() == 0
    assert sum(r["count"] for r in C.histogram(v, "v").collect()) == 11


def test_pie_other_and_angles(spark):
    rows = [(f"c{i:02d}", float(i)) for i in range(20)] + [("neg", -5.0), (None, 3.0)]
    p = C.pie(spark.createDataFrame(rows, "c string, v double"), "c", "v").collect()
    assert len(p) == 12 and p[-1].category == "Other" and p[-1].to_angle == 360.0 and abs(sum(r.share for r in p) - 1) < 1e-12
    few = C.pie(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "c string, v double"), "c", "v").collect()
    assert [r.category for r in few] == ["b", "a"] and few[-1].to_angle == 360.0


def test_correlation_needs_points_and_spread(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    got = {r.series: r.r for r in C.correlation(points(spark, rows), "x", "y", "s").collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] is None and got["c"] is None


def test_column_kinds_and_labels(spark):
    df = spark.createDataFrame([("1", "2024-01", "n/a", "x"), ("-2.5e3", "2024-01-02T10:00", "", "1"), ("none", None, None, None)], "a string, b string, c string, d string")
    assert {r.column: r.kind for r in C.column_kinds(df).collect()} == {"a": "numeric", "b": "time", "c": "empty", "d": "text"}
    labels = spark.createDataFrame([("b",), ("10",), ("9",), ("2024-01-02",), ("a",), (None,), ("9",)], "l string")
    assert [r.label for r in C.label_order(labels, "l").orderBy("place").collect()] == ["9", "10", "2024-01-02", "a", "b"]


def test_aggregates_over_finite_values(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", float("inf")), ("b", 2.0)], "k string, v double")
    got = {r.k: (r.s, r.n) for r in df.groupBy("k").agg(C.aggregate("v", "sum").alias("s"), C.aggregate("v", "count").alias("n")).collect()}
    assert got == {"a": (None, 0.0), "b": (2.0, 1.0)}
    with pytest.raises(ValueError):
        C.aggregate("v", "mode")


def test_scatter_keeps_few_points(spark):
    pts = points(spark, [("", float(i % 50), float(i // 50)) for i in range(5000)])
    assert C.scatter(pts, "x", "y", 10_000).count() == 5000
    cells = C.scatter(pts, "x", "y", 1000).collect()
    # Three points hold the extremes of both axes; they are in their cells as well.
    assert len(cells) <= 1000 and sum(r.n for r in cells) == 5003
    assert {(0.0, 0.0, 1), (49.0, 0.0, 1), (0.0, 99.0, 1)} <= {(r.x, r.y, r.n) for r in cells}
