"""Web pages, sitemaps, feeds and crawls as tables; nothing is fetched."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine.batches import keyed, restored
from millrace.engine.running import running
from millrace.engine.session import cut
from millrace.functions import text as X

#: Parts of a page that hold no content of its own.
JUNK = {"script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form", "iframe", "header"}
_BLOCKS = {"p", "div", "section", "article", "main", "td", "th", "figcaption", "dd", "dt", "body"}
BLOCK = "pos bigint, kind string, level int, text string, path string"
FEED_ITEMS = 60
_SECTION = re.compile(r"(?i)<!\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])")
#: Numbers of so many digits that Python refuses to read them.
_LONG_NUMBER = re.compile(r"&#([0-9]{1000,})")


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int | None, str]] = []
        self.held: list[str] = []
        self.skip = 0
        self.kind, self.level = "para", None
        self.pre = 0
        self.row: list[str] | None = None

    def flush(self, kind: str = "para", level: int | None = None) -> None:
        text = "".join(self.held)
        text = text.strip("\n") if self.pre else re.sub(r"\s+", " ", text).strip()
        if text:
            self.out.append((self.kind, self.level, text))
        self.held, self.kind, self.level = [], kind, level

    def handle_starttag(self, tag, attrs):
        if tag in JUNK:
            self.skip += 1
        if self.skip:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.flush("heading", int(tag[1]))
        elif tag == "li":
            self.flush("list")
        elif tag == "tr":
            self.flush("table")
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            if self.held:
                self.held.append(" | ")
        elif tag == "pre":
            self.flush("code")
            self.pre += 1
        elif tag == "blockquote":
            self.flush("quote")
        elif tag == "img":
            alt = dict(attrs).get("alt")
            if alt:
                kind, level = self.kind, self.level
                self.flush("media")
                self.held.append(alt)
                self.flush(kind, level)
        elif tag == "br":
            self.held.append("\n")
        elif tag in _BLOCKS and self.kind != "quote":
            self.flush()

    def handle_endtag(self, tag):
        if tag in JUNK:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if re.fullmatch(r"h[1-6]|li|tr|blockquote", tag) or tag in _BLOCKS and self.row is None and self.kind != "quote":
            self.flush()
        if tag == "tr":
            self.row = None
        if tag == "pre":
            self.flush()
            self.pre = max(0, self.pre - 1)

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)

    def parse_marked_section(self, i, report=1):
        # The library raises on a section of no known name; in a page it is a comment up to the next ">".
        if _SECTION.match(self.rawdata, i):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i)


def blocks_of(html: str) -> list[tuple[int, str, int | None, str, str]]:
    """(pos, kind, level, text, path) of a page's headings, paragraphs, list items, rows, code, quotes and media; path is the
    headings above. A text repeated right after itself is one block."""
    p = _Blocks()
    p.feed(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0") or "0")[:8], html))
    p.close()
    p.flush()
    out, heads = [], []
    for kind, level, text in p.out:
        if out and out[-1][3] == text and out[-1][1] == kind:
            continue
        if kind == "heading":
            heads = [h for h in heads if h[0] < level]
        out.append((len(out) + 1, kind, level, text, " > ".join(h[1] for h in heads)))
        if kind == "heading":
            heads.append((level, text))
    return out


def blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pos, kind, level, text, path). Null pages give nothing; broken markup what can be read of it."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, h in zip(b["id_"], b["html_"]) for x in blocks_of(h)]
            yield pd.DataFrame(rows, columns=["id_", "pos", "kind", "level", "text", "path"]).astype({"level": "Int64"})

    some = pages.where(F.col(html_col).isNotNull()).select(keyed(id_col), F.col(html_col).alias("html_"))
    return restored(some.mapInPandas(run, f"id_ string, {BLOCK}"), id_col, kind)


def content_kind(found: DataFrame, id_col: str) -> DataFrame:
    """(id, kind): code, table, list or page, by what most characters of a page are in."""
    n = F.length("text")
    a = found.groupBy(id_col).agg(F.sum(n).alias("all_"), *[F.sum(F.when(F.col("kind") == k, n).otherwise(0)).alias(k) for k in ("code", "table", "list")])
    kind = F.lit("page")
    for k in ("list", "table", "code"):
        kind = F.when(F.col(k) * 2 > F.col("all_"), k).otherwise(kind)
    return a.select(id_col, kind.alias("kind"))


#: Fixed value: the share of a page's best score that a passage needs.
PASSAGE = 0.15


def focus(found: DataFrame, id_col: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, pos, score, kept) of the blocks of pages: how well each answers the query among the blocks of its own page.

    BM25 over a page's blocks, times the share of the query's weight that a block holds. Terms in half of a page's blocks
    or more don't count where another term is rarer; terms that a page lacks don't either. Kept are blocks of at least
    ``PASSAGE`` of the page's best score; where nothing matches, all are, with a score of 0.
    """
    terms = X.query_terms(query)
    d = found.select(id_col, "pos", X.tokens(F.coalesce("text", F.lit(""))).alias("t_"))
    d = d.select(id_col, "pos", F.size("t_").cast("double").alias("l_"), *[F.size(F.filter("t_", _equal(w))).cast("double").alias(f"n{i}_") for i, w in enumerate(terms)])
    per = d.groupBy(F.col(id_col).alias("i_")).agg(F.count(F.lit(1)).alias("all_"), F.avg("l_").alias("mean_"), *[F.count_if(F.col(f"n{i}_") > 0).alias(f"d{i}_") for i in range(len(terms))])
    rare = F.lit(False)
    for i in range(len(terms)):
        rare = rare | (F.col(f"d{i}_") > 0) & (F.col(f"d{i}_") * 2 < F.col("all_"))
    per = per.withColumn("rare_", rare)
    d = d.join(per.hint("merge"), F.col(id_col).eqNullSafe(F.col("i_")))
    score = weight = have = F.lit(0.0)
    for i in range(len(terms)):
        n, df = F.col(f"n{i}_"), F.col(f"d{i}_")
        counts = (df > 0) & ~(F.col("rare_") & (df * 2 >= F.col("all_")))
        idf = F.when(counts, F.ln(1 + (F.col("all_") - df + 0.5) / (df + 0.5))).otherwise(0.0)
        score = score + idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("l_") / F.greatest("mean_", F.lit(1.0))))
        weight, have = weight + idf, have + F.when(n > 0, idf).otherwise(0.0)
    scored = d.select(id_col, "pos", F.when(weight > 0, score * have / F.when(weight > 0, weight)).otherwise(0.0).alias("score"))
    best = scored.groupBy(F.col(id_col).alias("i_")).agg(F.max("score").alias("best_"))
    out = scored.join(best.hint("merge"), F.col(id_col).eqNullSafe(F.col("i_")))
    return out.select(id_col, "pos", "score", ((F.col("best_") <= 0) | (F.col("score") >= PASSAGE * F.col("best_"))).alias("kept"))


def _equal(w: str):
    return lambda t: t == F.lit(w)


def script_json(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pos, kind, json): the JSON that pages carry in scripts: those of a JSON type (kind ``type``), and values
    assigned in one statement (kind: the name). What doesn't parse is left out; null pages give nothing."""
    typed = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<script\b[^>]*type=[\"']application/(?:ld\+)?json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    named = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<script\b[^>]*>\s*((?:window\.|var |let |const )?[\w.$]+\s*=\s*[{\[].*?);?\s*</script>"), F.lit(1))
    one = lambda kind: lambda x: F.struct(kind(x).alias("kind"), F.trim(F.regexp_replace(x, r"(?s)^(?:window\.|var |let |const )?[\w.$]+\s*=\s*", "")).alias("json"))
    values = F.concat(F.transform(typed, one(lambda x: F.lit("type"))), F.transform(named, one(lambda x: F.regexp_extract(x, r"^(?:window\.|var |let |const )?([\w.$]+)", 1))))
    kept = F.filter(values, lambda v: F.json_array_length(v["json"]).isNotNull() | F.json_object_keys(v["json"]).isNotNull())
    return pages.where(F.col(html_col).isNotNull()).select(id_col, F.posexplode(kept).alias("p_", "v_")).select(id_col, (F.col("p_") + 1).cast("long").alias("pos"), "v_.kind", "v_.json")


def links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(from_key, to_key, url): absolute links between pages by URL key, once each."""
    href = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<a\s[^>]*href=[\"'](https?://[^\"'#\s]+)"), F.lit(1)))
    out = pages.where(F.col(html_col).isNotNull()).select(X.url_key(F.col(url_col)).alias("from_key"), href.alias("url"))
    return out.select("from_key", X.url_key(F.col("url")).alias("to_key"), "url").distinct()


def sitemap_entries(xml: str) -> list[tuple[str, str | None, float | None, bool]]:
    """(loc, lastmod, priority, is_index) of a sitemap or an index of sitemaps; of broken XML what can be found."""
    try:
        root = ET.fromstring(xml)
        index = root.tag.endswith("sitemapindex")
        out = []
        for e in root:
            got = {c.tag.rsplit("}", 1)[-1]: (c.text or "").strip() for c in e}
            if got.get("loc"):
                try:
                    priority = float(got["priority"]) if got.get("priority") else None
                except ValueError:
                    priority = None
                out.append((got["loc"], got.get("lastmod") or None, priority, index))
        return out
    except ET.ParseError:
        return [(x.strip(), None, None, "<sitemapindex" in xml) for x in re.findall(r"<loc>\s*([^<]+?)\s*</loc>", xml)]


def feed_items(xml: str, most: int | None = FEED_ITEMS) -> list[tuple[str, str, str | None]]:
    """(title, url, published) of an RSS, Atom or JSON feed, the first ``most`` or, with None, all."""
    import json

    if xml.lstrip()[:1] == "{":
        try:
            items = json.loads(xml).get("items") or []
        except ValueError:
            return []
        return [(i.get("title") or "", i.get("url") or "", i.get("date_published")) for i in items if isinstance(i, dict)][:most]
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    for e in root.iter():
        if e.tag.rsplit("}", 1)[-1] not in ("item", "entry"):
            continue
        got, link = {}, None
        for c in e:
            name = c.tag.rsplit("}", 1)[-1]
            if name == "link":
                link = c.get("href") or (c.text or "").strip() or link
            got.setdefault(name, (c.text or "").strip())
        out.append((got.get("title", ""), link or "", got.get("pubDate") or got.get("published") or got.get("updated")))
    return out[:most]


def parsed(df: DataFrame, id_col: str, text_col: str, what: str, most: int | None = FEED_ITEMS) -> DataFrame:
    """Entries of sitemaps (``what`` = sitemap) or feeds (feed, the first ``most`` of each, with None all), one row each."""
    kind = df.schema[id_col].dataType.simpleString()
    read, cols = (sitemap_entries, "loc string, lastmod string, priority double, is_index boolean") if what == "sitemap" else (lambda t: feed_items(t, most), "title string, url string, published string")
    names = [c.split()[0] for c in cols.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(b["id_"], b["text_"]) for x in read(t)], columns=["id_", *names], dtype=object)

    some = df.where(F.col(text_col).isNotNull()).select(keyed(id_col), F.col(text_col).alias("text_"))
    return restored(some.mapInPandas(run, f"id_ string, {cols}"), id_col, kind)


def robots_rules(text: str, agent: str = "*") -> list[tuple[str, bool]]:
    """(rule, allowed) of the group of an agent in a robots file, else of all."""
    groups: dict[str, list] = {}
    names: list[str] = []
    fresh = False
    for line in text.splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if fresh else [value.lower()]
            fresh = True
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            fresh = False
            if value:
                for n in names:
                    groups[n].append((value, key == "allow"))
    return groups.get(agent.lower(), groups.get("*", []))


def allowed(paths: DataFrame, path_col: str, rules: list[tuple[str, bool]]) -> DataFrame:
    """``paths`` with ``allowed``: the longest rule that covers a path decides, of equal ones the allowing; none allows."""
    best = F.lit(-1)
    verdict = F.lit(True)
    for rule, ok in sorted(rules, key=lambda r: (len(r[0]), r[1])):
        hit = X.rule_matches(F.lit(rule), F.col(path_col))
        verdict = F.when(hit, F.lit(ok)).otherwise(verdict)
    del best
    return paths.withColumn("allowed", verdict)


def crawl(seeds: DataFrame, edges: DataFrame, depth: int, most_pages: int | None = None) -> DataFrame:
    """(key, depth): pages reached from the seeds (key) over edges (from_key, to_key), each at its least depth; at most
    ``most_pages``, nearer and then lesser keys first. One join per level, written to the shared folder."""
    seen = cut(seeds.select("key").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for level in range(1, depth + 1):
        step = edges.join(front.select(F.col("key").alias("k_")), F.col("from_key") == F.col("k_"), "left_semi").select(F.col("to_key").alias("key")).distinct()
        front = cut(step.join(seen.select("key"), "key", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen.orderBy("depth", "key").limit(most_pages) if most_pages else seen


def share_budget(pages: DataFrame, length_col: str, order: list[str], per_page: int, total: int) -> DataFrame:
    """``pages`` with ``granted``: characters each page may show, at most ``per_page``, until ``total`` is spent."""
    want = F.least(F.col(length_col), F.lit(per_page))
    placed = running(pages.withColumn("want_", want), order, "want_")
    return placed.withColumn("granted", F.greatest(F.lit(0), F.least("want_", F.lit(total) - F.col("before_")))).drop("want_", "before_", "place_")


#: What pages say that ask for a login or a proof.
WALLS = {"challenge": r"(?i)captcha|are you a robot|verify you are human|checking your browser|cf-chl", "login": r"(?i)\b(?:log|sign) in to (?:continue|view|read)|please log in", "paywall": r"(?i)subscribe to (?:continue|read)|subscribers only", "cookies": r"(?i)we use cookies|cookie policy"}


def walls(pages: DataFrame, text_col: str) -> DataFrame:
    """``pages`` with ``wall``: the first kind of wall whose words a short page has, else null."""
    kind = F.lit(None).cast("string")
    for k, p in reversed(WALLS.items()):
        kind = F.when(F.col(text_col).rlike(p), k).otherwise(kind)
    return pages.withColumn("wall", F.when(F.length(text_col) <= 700, kind))


def metadata(html: str) -> dict[str, str | None]:
    """title, byline, published and site of a page, from its meta elements and title."""
    meta = {}
    for tag in re.findall(r"(?is)<meta\s[^>]*>", html):
        a = dict((k.lower(), v) for k, _, v in re.findall(r"(?s)([\w:.-]+)\s*=\s*(['\"])(.*?)\2", tag))
        name = (a.get("property") or a.get("name") or "").lower()
        if name and a.get("content"):
            meta.setdefault(name, a["content"].strip())
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
    first = lambda *ns: next((meta[n] for n in ns if n in meta), None)
    time = re.search(r"(?i)<time[^>]*datetime=[\"']([^\"']+)", html)
    return {
        "title": first("og:title", "twitter:title") or (re.sub(r"\s+", " ", title[1]).strip() if title else None), "byline": first("author", "article:author"),
        "published": first("article:published_time", "date", "dc.date") or (time[1] if time else None), "site": first("og:site_name", "application-name"),
    }


def charset(data: bytes, header: str | None = None) -> str:
    """The character set of a page: the header's, a byte-order mark's, the page's own, else utf-8 if it decodes."""
    import codecs

    found = [re.search(r"(?i)charset=[\"']?([\w-]+)", header or "")]
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name
    found.append(re.search(r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", data[:4096].decode("latin-1")))
    for m in found:
        if m:
            try:
                return codecs.lookup(m[1]).name
            except LookupError:
                continue
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "windows-1252"
