"""Chart data: tables of points reduced to what a chart of bounded size shows. Nothing is drawn.

Every reduction is an aggregate or a window over already aggregated rows, so its cost is one shuffle of partial results
and its answer is bounded by the chart (categories, cells, bins), not by the table.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.engine.running import running

CATEGORIES, SERIES, CELLS, SLICES, BUBBLES, BINS = 100, 24, 80, 12, 2_000, 1_000


def finite(c: Column | str) -> Column:
    """The number, null where it is NaN or infinite."""
    c = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def aggregate(value: Column | str, how: str) -> Column:
    """sum, mean, count, min, max or median of the finite values; the count of none is 0, the others are null."""
    v = finite(value)
    if how not in ("sum", "mean", "count", "min", "max", "median"):
        raise ValueError(f"no aggregate {how!r}")
    return {"sum": F.sum, "mean": F.avg, "count": lambda c: F.count(c).cast("double"), "min": F.min, "max": F.max, "median": F.median}[how](v)


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, numbers, times, texts, kind) in one pass: a column is ``numeric`` or ``time`` when all its cells that
    say something are, ``empty`` without any, else ``text``."""
    from millrace.functions.scalars import null_marked, number_of

    exprs = []
    for c in df.columns:
        t = null_marked(F.col(f"`{c}`").cast("string"))
        num, tim = number_of(t).isNotNull(), t.rlike(r"^\d{4}-\d{2}(?:-\d{2})?(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
        exprs.append(F.struct(F.lit(c).alias("column"), F.count_if(t.isNotNull() & num).alias("numbers"), F.count_if(t.isNotNull() & tim).alias("times"), F.count_if(t.isNotNull() & ~num & ~tim).alias("texts")).alias(f"k{len(exprs)}"))
    if not exprs:
        return df.sparkSession.createDataFrame([], "column string, numbers long, times long, texts long, kind string")
    one = df.agg(*exprs).select(F.inline(F.array(*[F.col(f"k{i}") for i in range(len(exprs))])))
    some = F.col("numbers") + F.col("times") + F.col("texts")
    kind = F.when(some == 0, "empty").when(F.col("numbers") == some, "numeric").when(F.col("times") == some, "time").otherwise("text")
    return one.withColumn("kind", kind)


def totals(df: DataFrame, category: str, value: str, how: str = "sum", keep: int = CATEGORIES) -> DataFrame:
    """(category, total): the ``keep`` largest categories, ties by name."""
    t = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(aggregate(value, how).alias("total"))
    return t.orderBy(F.desc_nulls_last("total"), "category").limit(keep)


def grid(df: DataFrame, category: str, series: str, value: str, how: str = "sum") -> DataFrame:
    """(category, series, value) cells; rows without either label are left out."""
    some = df.where(F.col(category).isNotNull() & F.col(series).isNotNull())
    return some.groupBy(F.col(category).alias("category"), F.col(series).alias("series")).agg(aggregate(value, how).alias("value"))


def line(df: DataFrame, x: str, value: str, series: str | None = None, how: str = "mean") -> DataFrame:
    """(series, x, y): one point per series and x."""
    s = F.col(series) if series else F.lit("")
    return df.where(F.col(x).isNotNull()).groupBy(s.alias("series"), F.col(x).alias("x")).agg(aggregate(value, how).alias("y"))


def pie(df: DataFrame, category: str, value: str, how: str = "sum", most: int = SLICES) -> DataFrame:
    """(category, total, share, from_angle, to_angle) of the categories with a positive total, in falling order. Beyond
    ``most`` categories all but the largest ``most`` - 1 are one slice, Other, the last; the last slice ends at 360."""
    t = df.where(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(aggregate(value, how).alias("total")).where("total > 0")
    top = t.orderBy(F.desc("total"), "category").limit(most + 1).withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "category")))
    many = t.agg(F.sum("total").alias("whole"), F.count(F.lit(1)).alias("n"))
    kept = top.crossJoin(F.broadcast(many)).where(F.when(F.col("n") > most, F.col("place") < most).otherwise(True))
    shown = kept.agg(F.sum("total").alias("s"), F.max("n").alias("n"), F.max("whole").alias("whole"))
    other = shown.where(F.col("n") > most).select(F.lit("Other").alias("category"), (F.col("whole") - F.col("s")).alias("total"), F.lit(most).alias("place"), "whole")
    slices = kept.select("category", "total", "place", "whole").unionByName(other)
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("total").over(w)
    last = F.max("place").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end = F.when(F.col("place") == last, F.lit(360.0)).otherwise(run / F.col("whole") * 360)
    return slices.select("category", "total", (F.col("total") / F.col("whole")).alias("share"), ((run - F.col("total")) / F.col("whole") * 360).alias("from_angle"), end.alias("to_angle"))


def nice_edges(lo: float, hi: float, count: int) -> list[float]:
    """Edges at multiples of 1, 2 or 5 times a power of ten that cover the span, about ``count`` of them."""
    raw = (hi - lo) / max(2, min(count, 50))
    power = math.floor(math.log10(raw))
    m = raw / 10**power
    step_m = 1 if m <= math.sqrt(2) else 2 if m <= math.sqrt(10) else 5 if m <= math.sqrt(50) else 10
    step = step_m * 10.0**power
    first, last = math.floor(lo / step + 1e-9), math.ceil(hi / step - 1e-9)
    return [round(i * step, max(0, -power)) for i in range(first, last + 1)]


def histogram(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, count): ``bins`` equal bins, or nice ones (their number by the logarithm of the rows, 5 to 40).
    A bin takes its left edge, the last one its right edge too. Empty bins are rows; without values there are none."""
    v = finite(value)
    lo, hi, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    schema = "bin long, low double, high double, count long"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    if bins:
        bins = max(1, min(bins, BINS))
        edges = [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
    else:
        edges = nice_edges(lo, hi, max(5, min(40, math.ceil(math.log2(n)) + 1 if n > 1 else 1)))
    at = F.least(F.expr(f"size(filter(array({', '.join(f'{e!r}D' for e in edges)}), e -> e <= v_))"), F.lit(len(edges) - 1)) - 1
    counts = df.select(v.alias("v_")).where("v_ IS NOT NULL").select(at.cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin long, low double, high double")
    return frame.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))


def box(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """(category, n, q1, median, q3, low, high, outliers): quartiles by linear interpolation, whiskers at the furthest
    values within 1.5 interquartile ranges, the number of values beyond."""
    g = F.col(group) if group else F.lit("")
    rows = df.select(g.alias("category"), finite(value).alias("v")).where("v IS NOT NULL")
    q = rows.groupBy("category").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("v").alias("n"))
    q = q.select(F.col("category").alias("c_"), "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr)
    j = rows.join(q, F.col("category").eqNullSafe(F.col("c_")))
    return j.groupBy("category", "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("outliers"))


def outliers(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """(category, value, count): the values beyond the whiskers of ``box``, and how often each occurs."""
    g = F.col(group) if group else F.lit("")
    rows = df.select(g.alias("category"), finite(value).alias("value")).where("value IS NOT NULL").groupBy("category", "value").agg(F.count(F.lit(1)).alias("count"))
    b = box(df, value, group).select(F.col("category").alias("c_"), "low", "high")
    j = rows.join(b.hint("merge"), F.col("category").eqNullSafe(F.col("c_")))
    return j.where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).select("category", "value", "count")


def correlation(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """(series, n, r): Pearson's, none under three points or without spread, kept within -1 and 1."""
    g = F.col(group) if group else F.lit("")
    rows = df.select(g.alias("series"), finite(x).alias("x"), finite(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    a = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / (F.col("sx") * F.col("sy")))))
    return a.select("series", "n", r.alias("r"))


def heatmap(df: DataFrame, x: str, y: str, value: str, how: str = "mean", most: int = CELLS) -> DataFrame:
    """(x, y, value, norm): cells of the first ``most`` labels of either axis; norm runs from 0 to 1, or where values have
    both signs from 0 over 0.5 at zero to 1."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(aggregate(value, how).alias("value"))
    for axis in ("x", "y"):
        kept = some.select(F.col(axis).alias("k_")).distinct().orderBy("k_").limit(most)
        some = some.join(F.broadcast(kept), F.col(axis) == F.col("k_"), "left_semi")
    span = F.broadcast(some.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    far = F.greatest(F.abs("lo"), F.abs("hi"))
    norm = F.when(F.col("lo") == F.col("hi"), 0.5).when((F.col("lo") < 0) & (F.col("hi") > 0), 0.5 + F.col("value") / (2 * far)).otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return some.crossJoin(span).select("x", "y", "value", norm.alias("norm"))


def stack(df: DataFrame, x: str, series: str, value: str, how: str = "sum") -> DataFrame:
    """(category, series, value, low, high): values of one sign upon one another, from zero away, in the order of series."""
    cells = grid(df, x, series, value, how).where("value IS NOT NULL")
    w = Window.partitionBy("category", F.col("value") < 0).orderBy("series").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("value").over(w)
    return cells.select("category", "series", "value", (run - F.col("value")).alias("low"), run.alias("high"))


def extremes(df: DataFrame, series: str, x: str, y: str) -> DataFrame:
    """(series, points, gaps, total, low, low_x, high, high_x): per series; of equal extremes the first x counts."""
    v = finite(y)
    return df.groupBy(F.col(series).alias("series")).agg(
        F.count(v).alias("points"), F.count_if(v.isNull()).alias("gaps"), F.sum(v).alias("total"), F.min(v).alias("low"), F.min_by(F.col(x), F.when(v.isNotNull(), F.struct(v, F.col(x)))).alias("low_x"),
        F.max(v).alias("high"), F.min_by(F.col(x), F.when(v.isNotNull(), F.struct(-v, F.col(x)))).alias("high_x"),
    )


#: Widths of scatter cells that are tried, smallest first.
CELL_SIZES = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def scatter(df: DataFrame, x: str, y: str, most: int = 2_000, sizes: tuple = CELL_SIZES) -> DataFrame:
    """(x, y, n): the points themselves when they are few; else the mean of each cell of the smallest width that leaves at
    most ``most`` rows, and besides, each as one point, those of the lowest and highest x and y, which stay exact. All
    widths are counted in one pass. Of points equally far out the one of the lesser other coordinate counts."""
    pts = df.select(finite(x).alias("x"), finite(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    p, q = F.struct("x", "y"), F.struct("y", "x")
    far = [F.min(p), F.max_by(p, F.struct("x", -F.col("y"))), F.min_by(p, q), F.max_by(p, F.struct("y", -F.col("x")))]
    row = pts.agg(F.min("x").alias("lo_x"), F.min("y").alias("lo_y"), F.count(F.lit(1)).alias("n"), *[e.alias(f"e{i}") for i, e in enumerate(far)]).first()
    lo_x, lo_y = row["lo_x"], row["lo_y"]
    if row["n"] <= most:
        return pts.select("x", "y", F.lit(1).cast("long").alias("n"))
    ends = df.sparkSession.createDataFrame(sorted({(float(e["x"]), float(e["y"]), 1) for e in (row[f"e{i}"] for i in range(4))}), "x double, y double, n long")
    most = max(0, most - 4)
    cell = lambda s: [F.floor((F.col("x") - lo_x) / s), F.floor((F.col("y") - lo_y) / s)]
    counts = pts.agg(*[F.approx_count_distinct(F.struct(*cell(s)), 0.01).alias(f"s{s}") for s in sizes]).first()
    for s in sizes:
        if counts[f"s{s}"] <= most * 1.05 or s == sizes[-1]:
            cells = pts.groupBy(cell(s)[0].alias("cx"), cell(s)[1].alias("cy")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
            if s == sizes[-1] or cells.count() <= most:
                return cells.select("x", "y", "n").unionByName(ends)
    raise AssertionError("unreachable")


def bubbles(df: DataFrame, size: str, ties: list[str], keep: int = BUBBLES) -> DataFrame:
    """The ``keep`` rows of the largest size; ties by the columns named."""
    return df.orderBy(F.desc_nulls_last(finite(size)), *ties).limit(keep)


def _hull(p: list[tuple[float, float, int]]) -> list[tuple[float, float, int]]:
    """Vertices of the convex hull of points in order of (x, y)."""
    if len(p) <= 2:
        return p

    def half(points):
        out: list = []
        for q in points:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return list({q[2]: q for q in half(p) + half(p[::-1])}.values())


def downsample(df: DataFrame, x: str, y: str, most: int, series: str | None = None) -> DataFrame:
    """(series, x, y): at most ``most`` points per series, by largest triangles; first, last and extreme points stay.

    The points of a series, in order of x, fall into equal buckets. The triangle of a point with the one kept before and
    the mean of the next bucket is linear in the point, so the largest is at a vertex of the bucket's convex hull: buckets
    are reduced to hulls and means in parallel, and only those, at most ``most`` buckets of a few vertices, are walked in
    order. Points of equal x are in order of y.
    """
    s = F.col(series).cast("string") if series else F.lit("")
    pts = df.select(s.alias("series"), F.col(x).cast("double").alias("x"), finite(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    # Numbered over ranges of all points, so that one series of most points is sorted by many tasks.
    placed = running(pts, ["series", "x", "y"]).drop("before_")
    spans = placed.groupBy(F.col("series").alias("s_")).agg(F.min("place_").alias("first_"), F.count(F.lit(1)).alias("n"))
    placed = placed.join(spans.hint("merge"), F.col("series").eqNullSafe(F.col("s_"))).select("series", "x", "y", (F.col("place_") - F.col("first_")).cast("long").alias("i"), "n")
    inner = most - 2
    bucket = F.when(F.col("n") <= most, F.col("i")).when(F.col("i") == 0, -1).when(F.col("i") == F.col("n") - 1, inner).otherwise(F.floor((F.col("i") - 1) * inner / (F.col("n") - 2)))
    placed = placed.withColumn("bucket", bucket.cast("long")).withColumn("part", F.floor(F.col("i") / 50_000))

    def hulls(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        rows = []
        for bucket, h in g.groupby("bucket", sort=False):
            x, y, i = h["x"].to_numpy(), h["y"].to_numpy(), h["i"].to_numpy()
            total = (int(bucket), float(x.sum()), float(y.sum()), len(h))
            rows += [(*q, *total) for q in _hull(list(zip(x.tolist(), y.tolist(), i.tolist())))]
        out = pd.DataFrame(rows, columns=["x", "y", "i", "bucket", "sx", "sy", "k"])
        return out.assign(series=g["series"].iloc[0], n=g["n"].iloc[0], part=g["part"].iloc[0])[["series", "x", "y", "i", "n", "bucket", "sx", "sy", "k", "part"]]

    shape = "series string, x double, y double, i long, n long, bucket long, sx double, sy double, k long, part long"
    few = placed.where(F.col("n") <= most).select("series", "x", "y")
    reduced = placed.where(F.col("n") > most).groupBy("series", "part").applyInPandas(hulls, shape)

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        means = g.drop_duplicates(["bucket", "part"]).groupby("bucket")[["sx", "sy", "k"]].sum()
        by = {b: list(zip(h["x"], h["y"])) for b, h in g.sort_values("i").groupby("bucket")}
        keys = sorted(by)
        at = by[keys[0]][0]
        out = [at]
        for b, c in zip(keys[1:], keys[2:]):
            cx, cy = means.loc[c, "sx"] / means.loc[c, "k"], means.loc[c, "sy"] / means.loc[c, "k"]
            at = max(by[b], key=lambda p: abs((at[0] - cx) * (p[1] - at[1]) - (at[0] - p[0]) * (cy - at[1])))
            out.append(at)
        out.append(by[keys[-1]][0])
        kept = set(out)
        for pick in (g["y"].idxmin(), g["y"].idxmax()):
            kept.add((g.loc[pick, "x"], g.loc[pick, "y"]))
        rows = sorted(kept)
        return pd.DataFrame({"series": g["series"].iloc[0], "x": [p[0] for p in rows], "y": [p[1] for p in rows]})

    return few.unionByName(reduced.groupBy("series").applyInPandas(walk, "series string, x double, y double"))


def label_order(df: DataFrame, label: str) -> DataFrame:
    """(label, place): distinct labels, numbers first by value, then dates, then text."""
    from millrace.functions.scalars import number_of

    t = F.col("label")
    number, date = number_of(t), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))
    rank = F.when(number.isNotNull(), 0).when(date.isNotNull(), 1).otherwise(2)
    one = df.select(F.col(label).cast("string").alias("label")).where("label IS NOT NULL").distinct()
    return one.select("label", F.row_number().over(Window.orderBy(rank, number, date, "label")).cast("long").alias("place"))

KINDS = ("totals", "grid", "line", "pie", "histogram", "box", "scatter", "bubble", "heatmap", "stack", "table")


def chart(df: DataFrame, spec: dict) -> DataFrame:
    """The marks of a chart request: kind, x, y, series, size, agg, bins, limit. Unknown fields and kinds, and columns that
    aren't there, are refused in a sentence; only the columns named are read."""
    known = {"kind", "x", "y", "series", "size", "agg", "bins", "limit"}
    if extra := set(spec) - known:
        raise ValueError(f"unknown field {sorted(extra)[0]}")
    kind, x, y, s = spec.get("kind"), spec.get("x"), spec.get("y"), spec.get("series")
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    named = [c for c in dict.fromkeys((x, y, s, spec.get("size"))) if c]
    for c in named:
        if c not in df.columns:
            raise ValueError(f"there is no column {c}")
    df = df.select(*named)
    how, limit = spec.get("agg", "mean" if kind in ("line", "heatmap") else "sum"), spec.get("limit")
    if kind == "totals":
        return totals(df, x, y, how, limit or CATEGORIES)
    if kind == "grid":
        return grid(df, x, s, y, how)
    if kind == "line":
        return downsample(line(df, x, y, s, how), "x", "y", limit or 1_500, "series")
    if kind == "pie":
        return pie(df, x, y, how, limit or SLICES)
    if kind == "histogram":
        return histogram(df, y or x, spec.get("bins"))
    if kind == "box":
        return box(df, y, s or x)
    if kind == "scatter":
        return scatter(df, x, y, limit or 2_000)
    if kind == "bubble":
        return bubbles(df, spec["size"], [c for c in (x, y) if c], limit or BUBBLES)
    if kind == "heatmap":
        return heatmap(df, x, y, spec.get("size") or s, how, limit or CELLS)
    if kind == "stack":
        return stack(df, x, s, y, how)
    return df.limit(limit or 1_000)
