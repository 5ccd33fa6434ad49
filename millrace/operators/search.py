"""Fusion of ranked hit lists into one list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.engine.running import running
from millrace.functions import text as X

#: The weight of reciprocal ranks, of lists of one kind of page, of agreement, of relevance and of hosts.
RANK_K, VERTICAL, CONSENSUS, RELEVANCE, PRIOR, VERTICAL_ONLY = 60, 0.6, 0.5, 0.3, 0.15, 0.4
PER_HOST, TITLE = 2, 512


def fuse(
    hits: DataFrame, engines: DataFrame, query: str = "", priors: DataFrame | None = None, trust: DataFrame | None = None, most: int | None = 50, by: tuple[str, ...] = ()
) -> DataFrame:
    """(by..., key, url, title, snippet, published, engines, families, score, place).

    hits: (by..., engine, rank from 0, url, title, snippet, published). engines: (engine, family, vertical), a vertical
    engine is a family of its own and counts less. Of engines of one family the best contribution to a page counts; pages
    that several families name gain; relevance to ``query`` and the prior of the host are added; pages that verticals alone
    name lose. Of pages of one title the first stays, and at most two pages of a host come before the rest. priors: (host,
    prior); trust: (engine, trust). Pages are told apart by their URL key. ``by`` columns separate searches; ``most``
    pages of each are given, with None all. No window holds more than the first pages of a title, a host or, with
    ``most``, a search: places of all pages are told by ranges.
    """
    keys = [*by, "key"]
    e = engines.select(F.col("engine").alias("e_"), "family", "vertical")
    h = hits.join(F.broadcast(e), F.col("engine") == F.col("e_"), "left").drop("e_")
    weight = F.lit(1.0)
    if trust is not None:
        h = h.join(F.broadcast(trust.select(F.col("engine").alias("t_"), "trust")), F.col("engine") == F.col("t_"), "left").drop("t_")
        weight = F.coalesce("trust", F.lit(1.0))
    vertical = F.coalesce("vertical", F.lit(False))
    family = F.when(vertical, F.concat(F.lit("vertical:"), "engine")).otherwise(F.coalesce("family", "engine"))
    h = h.select(
        *by, "engine", "url", "published", X.url_key(F.col("url")).alias("key"), family.alias("fam"), vertical.alias("vert"), F.col("rank").alias("rank_"),
        (weight * F.when(vertical, VERTICAL).otherwise(1.0) / (RANK_K + F.col("rank") + 1)).alias("part"), X.collapsed(F.coalesce("title", F.lit("")), TITLE).alias("title"), X.collapsed(F.coalesce("snippet", F.lit(""))).alias("snippet"),
    )
    bad = F.contains("title", F.lit(" › ")) | F.startswith("title", F.lit("http")) | (F.length("title") < 3)
    per = h.groupBy(*keys, "fam").agg(
        F.max("part").alias("part"), F.min(F.struct(bad.alias("bad"), F.length("title").alias("n"), F.col("rank_").alias("r"), F.col("title").alias("v"))).alias("title"),
        F.max(F.struct(F.when(F.startswith("snippet", F.lit("Redirecting")), -1).otherwise(F.length("snippet")).alias("n"), F.col("snippet").alias("v"))).alias("snippet"),
        F.min(F.struct(F.col("rank_").alias("r"), F.col("url").alias("v"))).alias("url"), F.min("published").alias("published"), F.collect_set("engine").alias("engines"), F.max("vert").alias("vert"),
    )
    page = per.groupBy(*keys).agg(
        F.sum("part").alias("mass"), F.count(F.lit(1)).alias("families"), F.min("title").getField("v").alias("title"), F.max("snippet").getField("v").alias("snippet"), F.min("url").getField("v").alias("url"),
        F.min("published").alias("published"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("engines")))).alias("engines"), F.min(F.col("vert").cast("int")).alias("only_vertical"),
    )
    page = page.withColumn("score", F.col("mass") * (1 + CONSENSUS * (F.col("families") - 1)))
    if query:
        id_ = F.concat_ws("\x01", *keys)
        page = page.withColumn("id_", id_).withColumn("doc_", F.concat_ws(" ", "title", "snippet"))
        rel = X.bm25(page, "id_", "doc_", query).withColumnRenamed("score", "rel")
        # The best relevance of each search, one row.
        top = page.select("id_", *by).join(rel, "id_").groupBy(*by).agg(F.greatest(F.max("rel"), F.lit(1e-9)).alias("top_"))
        page = page.join(rel, "id_", "left")
        page = page.join(top, list(by), "left") if by else page.crossJoin(F.broadcast(top))
        page = page.withColumn("score", F.col("score") + RELEVANCE * F.coalesce(F.col("rel") / F.col("top_"), F.lit(0.0))).drop("id_", "doc_", "rel", "top_")
    if priors is not None:
        p = priors.select(F.col("host").alias("h_"), "prior")
        page = page.join(p, X.host(F.col("url")) == F.col("h_"), "left").withColumn("score", F.col("score") + PRIOR * F.coalesce("prior", F.lit(0.0))).drop("h_", "prior")
    page = page.withColumn("score", F.when(F.col("only_vertical") == 1, F.col("score") * VERTICAL_ONLY).otherwise(F.col("score")))
    order = [F.desc("score"), F.asc("key")]
    titled = page.where(F.length("title") > 0)
    same = Window.partitionBy(*by, F.lower("title")).orderBy(*order)
    page = titled.withColumn("dup_", F.row_number().over(same)).where("dup_ = 1").drop("dup_").unionByName(page.where(F.length("title") == 0))
    ranked = placed(page, most, by)
    return ranked.select(*by, "key", "url", "title", "snippet", "published", "engines", F.col("families").cast("long").alias("families"), "score", "place")


def placed(page: DataFrame, most: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Pages (by..., key, url, score, ...) with ``place``, the best scores first, but of each host only two before all
    others; the first ``most`` of each search."""
    keys, order = [*by, "key"], [F.desc("score"), F.asc("key")]
    hosted = page.select(*keys, F.coalesce(X.host(F.col("url")), F.lit("")).alias("host_"), "score")
    ahead = hosted.withColumn("turn_", F.row_number().over(Window.partitionBy(*by, "host_").orderBy(*order))).where(F.col("turn_") <= PER_HOST)
    page = page.join(ahead.select(*keys, F.lit(False).alias("after_")), keys, "left").withColumn("after_", F.coalesce("after_", F.lit(True)))
    order = ["after_", *order]
    if by:
        out = page.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        out = out.where(F.col("place") <= most) if most is not None else out
    elif most is not None:
        out = page.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    else:
        out = running(page, order).withColumnRenamed("place_", "place").drop("before_")
    return out.withColumn("place", F.col("place").cast("long")).drop("after_")


def numbered(results: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of placed results, their places without gaps."""
    return results.orderBy("place").limit(most).withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long"))


def engine_health(hits: DataFrame, least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., engine, hits, healthy): whether an engine gave at least ``least`` hits."""
    return hits.groupBy(*by, "engine").agg(F.count(F.lit(1)).alias("hits")).withColumn("healthy", F.col("hits") >= least)


def restrict(hits: DataFrame, query: str) -> DataFrame:
    """Hits that keep to the ``site:``, ``intitle:`` and ``filetype:`` terms of a query."""
    import re

    for word, quoted, bare in re.findall(r'(site|intitle|filetype):(?:"([^"]+)"|(\S+))', query):
        v = (quoted or bare).lower()
        h = X.host(F.col("url"))
        if word == "site":
            hits = hits.where((h == v) | F.endswith(h, F.lit(f".{v}")))
        elif word == "intitle":
            hits = hits.where(F.contains(F.lower("title"), F.lit(v)))
        else:
            hits = hits.where(F.endswith(F.lower(F.try_parse_url(F.col("url"), F.lit("PATH"))), F.lit(f".{v}")))
    return hits


#: What queries of a kind say; the words of ``CODE_WITH_TOOLS`` count beside one of ``TOOLS`` only, which also
#: counts by itself.
CODE = ("error", "exception", "traceback", "compile", "undefined", "null pointer", "segmentation fault", "syntax", "debug", "stack trace", "typeerror", "segfault", "stackoverflow")
CODE_WITH_TOOLS = ("how to", "install", "fix", "setup", "set up", "library", "function", "api", "crate", "package", "regex")
TOOLS = frozenset(
    (
        "npm cargo pip github docker kubernetes rust python javascript typescript golang c++ java ruby php swift kotlin linux git sql regex sdk cli json "
        "yaml api code script function library crate package compiler kernel async node react vue django flask postgres mysql redis nginx bash shell "
        "terminal vec"
    ).split()
)
PAPER = ("paper", "arxiv", "doi", "journal", "citation", "preprint", "ablation")
NEWS = ("news", "breaking", "latest", "announced", "dies", "election", "war", "stock")
ENTITY = ("what is", "who is", "who was", "define", "meaning of")


def intent(query: str) -> str:
    """code, news, paper, entity or web: the kind that most words and phrases of a query speak for, of equal ones the
    first. A query of up to three words that says nothing, two of them in capitals, names something."""
    import re

    words = re.findall(r"(?:[^\W_]|\+)+", query.lower())
    said = f" {' '.join(words)} "
    count = lambda phrases: sum(f" {p} " in said for p in phrases)
    tools = not TOOLS.isdisjoint(words)
    votes = {"code": count(CODE) + (count(CODE_WITH_TOOLS) + 1 if tools else 0), "news": count(NEWS), "paper": count(PAPER), "entity": count(ENTITY)}
    best = max(votes, key=votes.get)
    if votes[best]:
        return best
    plain = query.split()
    return "entity" if len(plain) <= 3 and sum(w[0].isupper() for w in plain) >= 2 else "web"


def weak(results: DataFrame, query: str, by: tuple[str, ...] = (), total: DataFrame | None = None) -> DataFrame:
    """(by..., weak): whether fewer than two families name the first page and fewer than eight pages were found, or none
    of the first three titles and snippets holds three fifths of the query's terms. total: all pages found, where the
    results are the first of them. Without results it is weak."""
    share = X.term_ratio(F.concat_ws(" ", "title", "snippet"), query)
    r = results.withColumn("share_", share)
    first = F.min(F.struct("place", "families")).getField("families")
    ranks = F.row_number().over(Window.partitionBy(*by).orderBy("place")) if by else F.row_number().over(Window.orderBy("place"))
    # At most the results of a call.
    r = r.withColumn("k_", ranks)
    a = [first.alias("f_"), F.count(F.lit(1)).alias("n_"), F.max(F.when(F.col("k_") <= 3, F.col("share_"))).alias("s_")]
    g = r.groupBy(*by).agg(*a) if by else r.agg(*a)
    if total is not None and not by:
        g = g.drop("n_").crossJoin(F.broadcast(total.agg(F.count(F.lit(1)).alias("n_"))))
    bare = F.lit(not X.query_terms(query))
    flag = (F.coalesce("f_", F.lit(0)) == 0) | ((F.col("f_") < 2) & (F.col("n_") < 8)) | ~bare & (F.coalesce("s_", F.lit(0.0)) < 0.6)
    return g.select(*by, flag.alias("weak"))
