"""What a search or a crawl gives in the end: ranked pages with the factors of coverage and authority, and pages within a
budget with the reason the crawl stopped. Answers come as tables; nothing is fetched."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.engine.running import running
from millrace.functions import text as X
from millrace.operators import search

#: Factors of a score.
LACKING, OFFICIAL, OFFICIAL_CODE, DOCUMENTS, PRIOR, PAPERS, TITLE, PHRASE, SURVEY = 0.3, 1.6, 1.8, 1.15, 1.2, 1.35, 0.35, 1.15, 0.65
#: Fixed values: (days at most, factor) of news; older ones, and the factor of those.
FRESH, STALE = ((1, 1.5), (3, 1.3), (7, 1.15), (30, 1.0)), 0.85
#: Words of a query that ask for documents or for papers, and words that say nothing of a title.
DOCUMENT_WORDS = ("docs", "documentation", "documented", "reference", "api", "specification", "spec", "official", "manual", "man page", "rfc", "changelog", "release notes")
PAPER_WORDS = ("paper", "papers", "study", "studies", "research", "arxiv")
TITLE_FILLERS = frozenset(
    (
        "the and for how what why who does with using from into about are was were has have you your can not but all any get set new latest "
        "news update updates official documentation docs doc guide tutorial explained example examples vs versus best good modern simple "
        "complete difference between when"
    ).split()
)
#: Hosts of papers.
PAPER_HOSTS = ("arxiv.org", "openreview.net", "semanticscholar.org", "scholar.google.com", "pubmed.ncbi.nlm.nih.gov", "aclanthology.org", "biorxiv.org", "papers.neurips.cc", "openaccess.thecvf.com")


@dataclass
class Asked:
    """What a query asks for that plain words don't tell: compounds in any spelling, versions and years."""

    compounds: list[tuple[str, ...]] = field(default_factory=list)
    versions: list[str] = field(default_factory=list)
    years: list[str] = field(default_factory=list)


def asked(query: str) -> Asked:
    out = Asked()
    for raw in query.lower().split():
        word = re.sub(r"^[^\w.-]+|[^\w.-]+$", "", raw.replace("_", " ").strip())
        if len(word) < 2:
            continue
        if "-" in word and any(c.isalpha() for c in word):
            out.compounds.append((word, word.replace("-", " "), word.replace("-", "")))
        elif re.fullmatch(r"[0-9]{1,3}\.[0-9]{1,3}", word):
            out.versions.append(word)
        elif re.fullmatch(r"20[0-9]{2}", word):
            out.years.append(word)
    return out


def coverage_factor(text: Column, query: str) -> Column:
    """1 for a text with all that the query asks for. It falls by ``LACKING`` for every compound that is missing, when
    another version of the same major number is there and none of those asked, and likewise for years. Null text lacks
    all."""
    want, low = asked(query), F.lower(F.coalesce(text, F.lit("")))
    factor = F.lit(1.0)
    for spellings in want.compounds:
        there = F.lit(False)
        for s in spellings:
            there = there | F.contains(low, F.lit(s))
        factor = factor * F.when(there, 1.0).otherwise(LACKING)
    if want.versions:
        named = F.lit(False)
        for v in want.versions:
            named = named | low.rlike(rf"(?<![0-9.]){re.escape(v)}(?![0-9])")
        majors = [v.split(".")[0] for v in want.versions]
        found = F.regexp_extract_all(low, F.lit(r"(?<![0-9])([0-9]{1,3}\.[0-9]{1,3})(?![0-9])"), F.lit(1))
        other = F.exists(found, lambda x: F.substring_index(x, ".", 1).isin(*majors) & ~x.isin(*want.versions))
        factor = factor * F.when(~named & other, LACKING).otherwise(1.0)
    if want.years:
        named = F.lit(False)
        for y in want.years:
            named = named | F.contains(low, F.lit(y))
        found = F.regexp_extract_all(low, F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), F.lit(1))
        factor = factor * F.when(~named & F.exists(found, lambda x: ~x.isin(*want.years)), LACKING).otherwise(1.0)
    return factor


def _under(host: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit(f".{d}"))
    return F.coalesce(out, F.lit(False))


def authority_factor(title: Column, url: Column, published: Column, query: str, intent: str = "web", official: dict[str, tuple[str, ...]] | None = None, prior: Column | None = None, today: str | None = None) -> Column:
    """How much a page's place gains: by an official host of what the query names, or a host with a prior; by being a
    primary source of papers where those are asked for; by the share of the query's words in its title, and the whole
    phrase there; in news by its age; and a survey loses where a benchmark is wanted.

    official: words that must all be in the query (separated by blanks), and the hosts they name. Hosts count with all
    below them. ``today`` is the current date unless given.
    """
    low = query.lower()
    words = re.findall(r"[^\W_]+", low)
    hosts = [d for named, ds in (official or {}).items() if set(named.lower().split()) <= set(words) for d in ds]
    host = X.host(url)
    is_official = _under(host, hosts)
    gain = (OFFICIAL_CODE if intent == "code" else OFFICIAL) * (DOCUMENTS if any(w in low for w in DOCUMENT_WORDS) else 1.0)
    has_prior = F.coalesce(prior > 0, F.lit(False)) if prior is not None else F.lit(False)
    factor = F.when(is_official, gain).when(has_prior, PRIOR).otherwise(1.0)
    if any(w in low for w in PAPER_WORDS):
        factor = factor * F.when(~is_official & _under(host, list(PAPER_HOSTS)), PAPERS).otherwise(1.0)
    in_title = F.lower(F.coalesce(title, F.lit("")))
    terms = [w for w in words if len(w.encode()) > 2 and w not in TITLE_FILLERS]
    if terms:
        factor = factor * (1 + TITLE * sum((F.contains(in_title, F.lit(w)).cast("double") for w in terms), F.lit(0.0)) / len(terms))
    phrase = re.sub(r"[\W_]", " ", low).strip()
    if len(phrase.encode()) >= 8:
        factor = factor * F.when(F.contains(F.trim(F.regexp_replace(in_title, r"[^\p{L}\p{N}]", " ")), F.lit(phrase)), PHRASE).otherwise(1.0)
    if intent == "news":
        age = F.date_diff(F.lit(today).cast("date") if today else F.current_date(), F.substring(published, 1, 10).try_cast("date"))
        fresh = F.when(age.isNull(), 1.0)
        for days, f in FRESH:
            fresh = fresh.when(age <= days, f)
        factor = factor * fresh.otherwise(STALE)
    if intent == "paper" and {"benchmark", "benchmarks"} & set(words) and not {"survey", "surveys", "review", "reviews"} & set(words):
        factor = factor * F.when(in_title.rlike(r"(?<![\p{L}\p{N}])(?:survey|review)(?![\p{L}\p{N}])"), SURVEY).otherwise(1.0)
    return factor


@dataclass
class Search:
    """results: (query, rank, url, title, snippet, engines, score). sets: (query, weak). health: (query, engine, hits,
    healthy)."""

    results: DataFrame
    sets: DataFrame
    health: DataFrame


def search_finish(hits: DataFrame, engines: DataFrame, queries: list[str], most: int = 7, intent: str | None = None, official: dict[str, tuple[str, ...]] | None = None, priors: DataFrame | None = None, today: str | None = None) -> Search:
    """The answer to a call's queries. hits: (query, engine, rank, url, title, snippet, published).

    Each query's hits are fused, scored with coverage and authority, ordered anew, kept to its ``site:``, ``intitle:`` and
    ``filetype:`` terms and cut to ``most``. A query without hits has no results and is weak. ``intent`` is told from the
    first query unless given.
    """
    intent = intent or search.intent(queries[0] if queries else "")
    results, sets = [], []
    for q in queries:
        plain = re.sub(r'(?:site|intitle|filetype):(?:"[^"]+"|\S+)', " ", q).strip()
        per = hits.where(F.col("query") == q).drop("query")
        pages = search.fuse(per, engines, plain, priors, most=None)
        text = F.concat_ws(" ", "title", "snippet", "url")
        factor = coverage_factor(text, plain) * authority_factor(F.col("title"), F.col("url"), F.col("published"), plain, intent, official, today=today)
        pages = search.placed(pages.withColumn("score", F.col("score") * factor).drop("place"), 3 * most)
        kept = search.restrict(pages, q)
        weak = search.weak(kept.orderBy("place").limit(max(3, most)), plain, total=kept)
        kept = search.numbered(kept, most)
        results.append(kept.select(F.lit(q).alias("query"), F.col("place").alias("rank"), "url", "title", "snippet", "engines", "score"))
        sets.append(weak.select(F.lit(q).alias("query"), "weak"))
    union = lambda fs: fs[0] if len(fs) == 1 else fs[0].unionByName(union(fs[1:]))
    return Search(union(results), union(sets), search.engine_health(hits, by=("query",)))


@dataclass
class Crawl:
    """pages: (url, depth, content, complete). inventory: (url). state: one row (pages_read, characters,
    inventory_truncated, stop_reason, complete)."""

    pages: DataFrame
    inventory: DataFrame
    state: DataFrame


def crawl_finish(fetched: DataFrame, found: DataFrame, seed: str, most_chars: int = 60_000, per_page: int = 8_000, map_limit: int = 120, most_pages: int = 10, remaining: bool = False, depth_limited: bool = False) -> Crawl:
    """The answer to a crawl. fetched: (place, url, depth, status, content), one row per page asked for; found: (url),
    addresses named by sitemaps and links.

    Pages answered with a 2xx and content give at most ``per_page`` characters each, in order of place, until
    ``most_chars`` is spent. The inventory has the different addresses of the seed's origin, the first ``map_limit`` in
    their order. Null contents are failures. The reason for the stop is the first of: map_limit, request_or_round_budget,
    content_budget, depth_limit, max_pages, frontier_empty_no_evidence, frontier_empty, partial_failures.
    """
    good = F.col("status").between(200, 299) & F.col("content").isNotNull()
    readable = fetched.where(good).withColumn("n_", F.least(F.length("content"), F.lit(per_page)))
    placed = running(readable.select("place", "url", "depth", "n_", F.length("content").alias("whole_")), ["place", "url"], "n_")
    granted = placed.withColumn("granted_", F.greatest(F.lit(0), F.least("n_", F.lit(most_chars) - F.col("before_"))))
    shown = granted.where((F.col("before_") < most_chars)).select("place", "url", "depth", "granted_", "whole_")
    texts = fetched.where(good).select(F.col("place").alias("p_"), F.col("url").alias("u_"), "content")
    pages = shown.join(texts, (F.col("place") == F.col("p_")) & (F.col("url") == F.col("u_"))).select(
        "url", "depth", F.substring("content", F.lit(1), F.col("granted_").cast("int")).alias("content"), (F.col("granted_") == F.col("whole_")).alias("complete")
    )
    origin = re.match(r"(?i)([a-z][a-z0-9+.-]*://[^/?#]+)", seed)
    inside = F.lit(False) if origin is None else F.lower(F.col("url")).rlike(f"^{re.escape(origin[1].lower())}(?:[/?#]|$)")
    every = fetched.select("url").unionByName(found.select("url")).where(inside).distinct()
    inventory = every.orderBy("url").limit(map_limit)
    cut = granted.agg(F.count_if(F.col("before_") < most_chars).alias("pages_read"), F.coalesce(F.sum("granted_"), F.lit(0)).alias("characters"), F.coalesce(F.max(F.col("granted_") < F.col("whole_")), F.lit(False)).alias("cut_"))
    counts = fetched.agg(F.count(F.lit(1)).alias("asked_"), F.coalesce(F.max(~F.coalesce(good, F.lit(False))), F.lit(False)).alias("failed_"))
    state = cut.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(every.agg(F.count(F.lit(1)).alias("known_"))))
    over = F.col("known_") > map_limit
    reason = (
        F.when(over, "map_limit").when(F.lit(remaining), "request_or_round_budget").when(F.col("cut_"), "content_budget").when(F.lit(depth_limited), "depth_limit")
        .when(F.col("asked_") >= most_pages, "max_pages").when(F.col("failed_"), "partial_failures").when((F.col("pages_read") == 0) & (F.col("known_") == 0), "frontier_empty_no_evidence").otherwise("frontier_empty")
    )
    state = state.select("pages_read", F.col("characters").cast("long").alias("characters"), over.alias("inventory_truncated"), reason.alias("stop_reason"))
    return Crawl(pages, inventory, state.withColumn("complete", F.col("stop_reason") == "frontier_empty"))
