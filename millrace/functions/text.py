"""Text expressions: URL keys, tokens, relevance, scripts and languages, shares of prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "msockid", "mc_cid", "mc_eid", "igshid", "ref_src", "_ga", "_gl")
#: Words too common to rank by.
STOP_WORDS = tuple("a an the and or but of in on at to for from by with without as is are was were be been it its this that these those into over under not no do does did how what when where which who why can could should would may might will".split())


def host(url: Column) -> Column:
    """The host of a URL in lower case without ``www.``; null where there is none."""
    return F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"(?i)^(?:www\.)+", ""))


def url_key(url: Column) -> Column:
    """What a URL names: host and path in lower case without index page and closing slashes, and the query without
    tracking keys. Text that is no URL is itself in lower case."""
    h = F.try_parse_url(url, F.lit("HOST"))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"(?:/index\.html)+$", ""), r"(?:/index\.htm)+$", "")
    pairs = F.split(F.try_parse_url(url, F.lit("QUERY")), "&")
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(pairs, lambda p: ~(F.startswith(key(p), F.lit("utm_")) | key(p).isin(*TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(h.isNull(), F.lower(url)).otherwise(F.concat(host(url), path, F.coalesce(query, F.lit(""))))


def collapsed(c: Column, most: int | None = None) -> Column:
    """Text with single blanks and none at its ends, cut to ``most`` characters."""
    out = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.substring(out, 1, most) if most else out


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits without accents' marks, stop words left out."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def bigrams(c: Column) -> Column:
    """Pairs of characters in a row of scripts written without blanks."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{2,}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold a term of the query. Term counts are kept for the query's terms only, so the
    shuffle is a row per document and term found; the statistics are one row."""
    import re

    terms = sorted({t for t in re.findall(r"[^\W_]+", query.lower()) if t not in STOP_WORDS})
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    t = docs.select(F.col(id_col), tokens(F.coalesce(text_col, F.lit(""))).alias("t_"))
    counts = [F.size(F.filter(F.col("t_"), _equals(w))).cast("double").alias(f"n{i}") for i, w in enumerate(terms)]
    t = t.select(id_col, F.size("t_").cast("double").alias("len_"), *counts)
    stats = t.agg(F.count(F.lit(1)).alias("docs_"), F.avg("len_").alias("mean_"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    j = t.where(" OR ".join(f"n{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.ln(1 + (F.col("docs_") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"n{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len_") / F.col("mean_")))
    return j.select(id_col, score.alias("score"))


def _equals(w: str):
    return lambda x: x == F.lit(w)


SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Han", "Hiragana", "Katakana")


def script_counts(c: Column) -> Column:
    """map<script, characters> of the letters of a text."""
    pairs = [x for s in SCRIPTS for x in (F.lit(s), F.regexp_count(c, F.lit(rf"\p{{Is{s}}}")).cast("long"))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


#: Words that tell languages written in Latin letters apart.
TELLING = {
    "en": ("the", "and", "of", "is", "that", "with", "for", "not", "this", "are"), "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "den", "mit", "von"),
    "fr": ("le", "les", "des", "est", "une", "dans", "que", "pas", "pour", "du"), "es": ("el", "los", "las", "una", "que", "por", "con", "para", "del", "se"),
}


def language(c: Column) -> Column:
    """The language a text is likely in, by script and, in Latin letters, by its small words; null when it can't be told."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    hits = {k: F.size(F.filter(words, _within(TELLING[k]))) for k in TELLING}
    best = F.greatest(*hits.values())
    latin = F.when(best < 2, F.lit(None).cast("string"))
    for k in TELLING:
        latin = latin.when(hits[k] == best, k)
    count = lambda s: F.regexp_count(c, F.lit(rf"\p{{Is{s}}}"))
    kana, han, half = count("Hiragana") + count("Katakana"), count("Han"), F.regexp_count(c, F.lit(r"\p{L}")) / 2
    return (
        F.when(c.isNull(), None).when(kana + han > half, F.when(kana > 0, "ja").otherwise("zh")).when(count("Hangul") > half, "ko").when(count("Cyrillic") > half, "ru")
        .when(count("Arabic") > half, "ar").when(count("Hebrew") > half, "he").when(count("Greek") > half, "el").when(count("Thai") > half, "th").when(count("Devanagari") > half, "hi").otherwise(latin)
    )


def _within(words: tuple):
    return lambda x: x.isin(*words)


def prose_share(c: Column) -> Column:
    """The share of characters on lines of at least 60 characters and 8 words."""
    lines = F.split(c, "\n")
    prose = F.filter(lines, lambda x: (F.length(x) >= 60) & (F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")) >= 8))
    return F.when(F.length(c) > 0, F.aggregate(prose, F.lit(0).cast("long"), lambda s, x: s + F.length(x)) / F.length(c)).otherwise(0.0)


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of the letters of a text in lower case."""
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}]+", " "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(bare) - 2)), lambda i: bare.substr(i, F.lit(3))))


def near_identical(a: Column, b: Column, threshold: float = 0.85) -> Column:
    """Whether two texts are equal without digits and punctuation, or share nearly all their trigrams."""
    x, y = (F.lower(F.regexp_replace(c, r"[^\p{L}]+", "")) for c in (a, b))
    p, q = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(p, q))
    return (x == y) | (both / (F.size(p) + F.size(q) - both) >= threshold)


def first_in_order(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def rule_matches(rule: Column, path: Column) -> Column:
    """Whether a robots rule covers a path: ``*`` stands for any text, ``$`` at the end for the end, else it is a prefix."""
    quoted = F.regexp_replace(F.regexp_replace(rule, r"\$$", ""), r"([\\.\[\]{}()+?^|$])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(F.endswith(rule, F.lit("$")), F.lit("$")).otherwise(F.lit("")))
    return F.regexp_like(path, pattern)


def unaccented(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    marked, bare = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīłńňőøřśşšťūůűźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeegilnnoorssstuuuzzz"
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), marked, bare), "ß", "ss"), "æ", "ae")


def stem(c: Column) -> Column:
    """A light stem: plural and verb endings of English words of more than three letters taken off."""
    w = F.regexp_replace(c, r"^(.{2,})ies$", "$1y")
    w = F.regexp_replace(w, r"^(.{2,}(?:s|x|z|ch|sh))es$", "$1")
    w = F.regexp_replace(w, r"^(.{2,}[^su])s$", "$1")
    w = F.regexp_replace(w, r"^(.{3,})(?:ing|ed)$", "$1")
    return F.when(F.length(c) > 3, w).otherwise(c)


def query_terms(query: str) -> list[str]:
    """The different words of a query without stop words."""
    import re

    return sorted({t for t in re.findall(r"[^\W_]+", query.lower()) if t not in STOP_WORDS})


def term_ratio(title: Column, query: str) -> Column:
    """The share of the query's terms that a title holds."""
    terms = query_terms(query)
    have = tokens(title)
    return sum((F.array_contains(have, t).cast("double") for t in terms), F.lit(0.0)) / max(1, len(terms))
