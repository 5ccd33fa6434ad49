"""Search fusion, text measures, pattern scan and review over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.engine.session import table
from millrace.functions import text as X
from millrace.operators import finish, review, scan, search

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ENGINES = [("brave", "brave", False), ("bing", "bing", False), ("ddg", "bing", False), ("mojeek", "mojeek", False), ("arxiv", "arxiv", True)]


def _hits(spark, d):
    """Hit lists made of the documents: each is named by two engines under a URL of its path, with tracking keys."""
    engine = F.array(*[F.lit(e) for e, _, _ in ENGINES])
    docs = table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", "path", "source", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    at = F.pmod(F.col("doc_id") + F.col("turn") * (F.col("doc_id") % 3 + 1), F.lit(5))
    url = F.concat(F.lit("https://www."), F.coalesce(F.regexp_replace("source", "/.*", ""), F.lit("none")), F.lit(".example/"), "path", F.lit("/index.html?utm_source=feed&v="), F.col("doc_id").cast("string"))
    return docs.select(F.element_at(engine, (at + 1).cast("int")).alias("engine"), F.pmod(F.col("doc_id") * 7 + F.col("turn") * 3, F.lit(50)).alias("rank"), url.alias("url"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("snippet"), F.lit(None).cast("string").alias("published"))


def _engines(spark):
    return spark.createDataFrame(ENGINES, "engine string, family string, vertical boolean")


_HITS = """hits AS (SELECT ['brave', 'bing', 'ddg', 'mojeek', 'arxiv'][1 + (doc_id + turn * (doc_id % 3 + 1)) % 5] AS engine, (doc_id * 7 + turn * 3) % 50 AS rank,
  coalesce(regexp_replace(source, '/.*', ''), 'none') || '.example' AS host, lower(coalesce(regexp_replace(source, '/.*', ''), 'none') || '.example/' || path) || '?v=' || doc_id AS key
  FROM documents, (VALUES (0), (1)) t(turn) WHERE path IS NOT NULL)"""


@query(f"""WITH {_HITS}, per AS (SELECT key, host, CASE engine WHEN 'arxiv' THEN 'vertical:arxiv' WHEN 'ddg' THEN 'bing' ELSE engine END AS fam, max(CASE engine WHEN 'arxiv' THEN 0.6 ELSE 1.0 END / (60 + rank + 1)) AS part, min(CASE engine WHEN 'arxiv' THEN 1 ELSE 0 END) AS v FROM hits GROUP BY ALL),
pages AS (SELECT key, host, CAST(count(*) AS BIGINT) AS families, sum(part) * (1 + 0.5 * (count(*) - 1)) * CASE WHEN min(v) = 1 THEN 0.4 ELSE 1 END AS score FROM per GROUP BY ALL),
turned AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY round(score, 9) DESC, key) AS turn FROM pages), placed AS (SELECT *, CAST(row_number() OVER (ORDER BY turn > 2, round(score, 9) DESC, key) AS BIGINT) AS place FROM turned)
SELECT key, families, round(score, 9) AS score FROM placed""")
def search_fusion(spark, d):
    """All pages ranked; places of equal scores fall by key, so only scores are compared."""
    return search.fuse(_hits(spark, d), _engines(spark), most=None).select("key", "families", F.round("score", 9).alias("score"))


@query(f"WITH {_HITS} SELECT engine, CAST(count(*) AS BIGINT) AS hits, count(*) >= 3 AS healthy FROM hits GROUP BY 1")
def search_engine_health(spark, d):
    return search.engine_health(_hits(spark, d))


@query(f"WITH {_HITS} SELECT key FROM hits WHERE host = 'wiki.example' OR host LIKE '%.wiki.example'")
def search_site_filter(spark, d):
    return search.restrict(_hits(spark, d), "schema site:wiki.example").select(X.url_key(F.col("url")).alias("key"))


@query(f"""WITH {_HITS}, per AS (SELECT key, host, CASE engine WHEN 'arxiv' THEN 'vertical:arxiv' WHEN 'ddg' THEN 'bing' ELSE engine END AS fam, max(CASE engine WHEN 'arxiv' THEN 0.6 ELSE 1.0 END / (60 + rank + 1)) AS part, min(CASE engine WHEN 'arxiv' THEN 1 ELSE 0 END) AS v FROM hits GROUP BY ALL),
pages AS (SELECT key, host, sum(part) * (1 + 0.5 * (count(*) - 1)) * CASE WHEN min(v) = 1 THEN 0.4 ELSE 1 END AS score FROM per GROUP BY ALL),
turned AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY round(score, 9) DESC, key) AS turn FROM pages),
first AS (SELECT *, row_number() OVER (ORDER BY turn > 2, round(score, 9) DESC, key) AS place FROM turned QUALIFY place <= 6000)
SELECT round(score, 9) AS score FROM first WHERE host = 'wiki.example' ORDER BY place LIMIT 2000""")
def search_finish(spark, d):
    """The first 2,000 pages of a search kept to one site; places of equal scores fall by key, so only scores are compared."""
    hits = _hits(spark, d).withColumn("query", F.lit("site:wiki.example"))
    return finish.search_finish(hits, _engines(spark), ["site:wiki.example"], most=2_000, intent="web").results.select(F.round("score", 9).alias("score"))


@query("""WITH t AS (SELECT doc_id, lower(path || ' ' || text) AS x FROM documents WHERE path IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, round(CASE WHEN contains(x, 're-entry') OR contains(x, 're entry') OR contains(x, 'reentry') THEN 1 ELSE 0.3 END
  * CASE WHEN NOT regexp_matches(x, '(^|[^0-9.])3[.]12($|[^0-9])') AND regexp_matches(x, '(^|[^0-9])3[.]([0-9]|[02-9][0-9]|1[013-9]|[0-9]{3})($|[^0-9])') THEN 0.3 ELSE 1 END
  * CASE WHEN NOT contains(x, '2024') AND regexp_matches(x, '(^|[^0-9])20([013-9][0-9]|2[0-35-9])($|[^0-9])') THEN 0.3 ELSE 1 END, 9) AS factor FROM t""")
def search_coverage(spark, d):
    docs = table(spark, d, "documents").where("path IS NOT NULL AND text IS NOT NULL")
    return docs.select("doc_id", F.round(finish.coverage_factor(F.concat_ws(" ", "path", "text"), "re-entry after 3.12 in 2024"), 9).alias("factor"))


#: Words of a query, and the hosts that are official for what they name.
OFFICIAL_HOSTS = {"ledger": ("wiki.example",), "ledger mailbox": ("handbook.example",), "socket": ("docs.example",)}


@query("""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS x, coalesce(regexp_replace(source, '/.*', ''), 'none') || '.example' AS host, date_diff('day', CAST(created_at AS DATE), DATE '2026-06-01') AS age FROM documents WHERE path IS NOT NULL)
SELECT doc_id, round(CASE WHEN host = 'wiki.example' THEN 1.6 * 1.15 ELSE 1 END * (1 + 0.35 * ((CASE WHEN contains(x, 'ledger') THEN 1 ELSE 0 END + CASE WHEN contains(x, 'snapshot') THEN 1 ELSE 0 END + CASE WHEN contains(x, 'api') THEN 1 ELSE 0 END) / 3))
  * CASE WHEN contains(trim(regexp_replace(x, '[^\\p{L}\\p{N}]', ' ', 'g')), 'api of the ledger snapshot') THEN 1.15 ELSE 1 END
  * CASE WHEN age IS NULL THEN 1 WHEN age <= 1 THEN 1.5 WHEN age <= 3 THEN 1.3 WHEN age <= 7 THEN 1.15 WHEN age <= 30 THEN 1 ELSE 0.85 END, 9) AS factor FROM t""")
def search_authority(spark, d):
    docs = table(spark, d, "documents").where("path IS NOT NULL")
    url = F.concat(F.lit("https://www."), F.coalesce(F.regexp_replace("source", "/.*", ""), F.lit("none")), F.lit(".example/a"))
    factor = finish.authority_factor(F.col("text"), url, F.date_format("created_at", "yyyy-MM-dd"), "API of the ledger snapshot", "news", OFFICIAL_HOSTS, today="2026-06-01")
    return docs.select("doc_id", F.round(factor, 9).alias("factor"))


def _crawled(spark, d):
    docs = table(spark, d, "documents")
    status = F.when(F.col("doc_id") % 7 == 0, 404).otherwise(200)
    fetched = docs.select(F.col("doc_id").alias("place"), F.concat(F.lit("https://docs.example/p"), F.col("doc_id").cast("string")).alias("url"), (F.col("doc_id") % 3).cast("int").alias("depth"), status.alias("status"), F.col("text").alias("content"))
    found = docs.where("path IS NOT NULL").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "https://docs.example/").otherwise("https://docs.example.org/"), "path").alias("url"))
    return finish.crawl_finish(fetched, found, "https://docs.example/start", most_chars=400_000, per_page=1_500, map_limit=500)


_CRAWLED = """good AS (SELECT doc_id AS place, 'https://docs.example/p' || doc_id AS url, text, least(length(text), 1500) AS n FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL),
run AS (SELECT *, coalesce(sum(n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM good),
granted AS (SELECT *, CAST(greatest(0, least(n, 400000 - before)) AS BIGINT) AS g FROM run),
every AS (SELECT 'https://docs.example/p' || doc_id AS url FROM documents UNION SELECT 'https://docs.example/' || path FROM documents WHERE path IS NOT NULL AND doc_id % 2 = 0)"""


@query(f"WITH {_CRAWLED} SELECT url, CAST(place % 3 AS INTEGER) AS depth, left(text, g) AS content, g = length(text) AS complete FROM granted WHERE before < 400000")
def crawl_finish(spark, d):
    """The pages that a crawl shows within its budget of characters, which is the feature."""
    return _crawled(spark, d).pages


@query(f"WITH {_CRAWLED} SELECT url FROM every ORDER BY url LIMIT 500")
def crawl_inventory(spark, d):
    return _crawled(spark, d).inventory


@query(f"WITH {_CRAWLED} SELECT CAST(count(*) FILTER (WHERE before < 400000) AS BIGINT) AS pages_read, CAST(sum(g) AS BIGINT) AS characters, (SELECT count(*) FROM every) > 500 AS inventory_truncated, CASE WHEN (SELECT count(*) FROM every) > 500 THEN 'map_limit' ELSE 'content_budget' END AS stop_reason, false AS complete FROM granted")
def crawl_state(spark, d):
    return _crawled(spark, d).state


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda x: x NOT IN (""" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + """)) AS w FROM documents),
c AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS l, len(list_filter(w, lambda x: x = 'ledger')) AS n1, len(list_filter(w, lambda x: x = 'mailbox')) AS n2 FROM t), s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE n1 > 0) AS d1, count(*) FILTER (WHERE n2 > 0) AS d2 FROM c)
SELECT doc_id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * n1 * 2.2 / (n1 + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * n2 * 2.2 / (n2 + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM c, s WHERE n1 > 0 OR n2 > 0""")
def text_bm25(spark, d):
    return X.bm25(table(spark, d, "documents"), "doc_id", "text", "the ledger of a mailbox").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN round(coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 60 AND len(list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda w: w <> '')) >= 8), lambda x: length(x))), 0) / length(text), 6) ELSE 0.0 END AS share FROM documents WHERE text IS NOT NULL")
def text_prose_share(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(X.prose_share(F.col("text")), 6).alias("share"))


_TELLING = " ".join(f"WHEN {k} = greatest({', '.join(X.TELLING)}) THEN '{k}'" for k in X.TELLING)


@query("WITH w AS (SELECT lang, text, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT lang, " + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(t) for t in ts)}))) AS {k}" for k, ts in X.TELLING.items())
       + f" FROM w), g AS (SELECT lang, CASE WHEN greatest({', '.join(X.TELLING)}) < 2 THEN NULL {_TELLING} END AS guess FROM h) SELECT lang, guess, CAST(count(*) AS BIGINT) AS documents FROM g GROUP BY ALL")
def text_language(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("lang", X.language(F.col("text")).alias("guess")).groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\p{Latin}')) AS BIGINT) AS latin FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(text, '\\p{Latin}')) > 0")
def text_scripts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.script_counts(F.col("text"))["Latin"].alias("latin")).where("latin > 0")


#: Fixed value: the class of what (?U)\s takes for blanks; the \s of the SQL side has ASCII blanks only.
BLANKS = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{BLANKS}+', ' ', 'g')) AS squeezed FROM documents WHERE text IS NOT NULL")
def text_collapse(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.collapsed(F.col("text")).alias("squeezed"))


#: Patterns that the documents hold.
DOC_MATCHERS = (
    scan.Matcher("long-number", "precise", (r"\b\d{4}-\d{2}-\d{2}\b",)),
    scan.Matcher("call", "normal", (r"\bcall to \w+_\w+",)),
    scan.Matcher("identifier", "noisy", (r"\b[a-z]+_[a-z]+\b",), ("rs", "py")),
)
_SCAN = """lines AS (SELECT doc_id, path, CAST(i AS BIGINT) AS line, x FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE path IS NOT NULL AND text IS NOT NULL)),
found AS (SELECT doc_id, path, 'long-number' AS slug, 'precise' AS tier, line FROM lines WHERE regexp_matches(x, '\\b\\d{4}-\\d{2}-\\d{2}\\b') UNION ALL SELECT doc_id, path, 'call', 'normal', line FROM lines WHERE regexp_matches(x, '\\bcall to \\w+_\\w+')
UNION ALL SELECT doc_id, path, 'identifier', 'noisy', line FROM lines WHERE regexp_matches(path, '[.](rs|py)$') AND regexp_matches(x, '\\b[a-z]+_[a-z]+\\b'))"""


#: Lines that are put below the documents, one each, for the built-in matchers to find or to pass over.
LINES = (
    'let password = "abcdefghij0123456789";', 'format!("query {{ Job {x} }}")', 'env::var("DB_PASSWORD").unwrap_or_default()', "const k = process.env.MY_SECRET ?? \"fallback\"", "h := sha1(data)", 'warn!("bad password {p}")', 'console.error("no token", t)',
    'Command::new("bash").arg("-c")', "c.args(format!(x))", "function onWebHook() {}", "base.join(&request_name)", '.route( "/x", get(h))', '#[post("/y")]', "let name = short;", 'Command::new("ls")',
)
_BELOW = "SELECT doc_id, ['rs', 'ts', 'py', 'RS'][1 + doc_id // 16 % 4] AS ext, text || chr(10) || [" + ", ".join("'" + x.replace("'", "''") + "'" for x in LINES) + f"][1 + doc_id % {len(LINES)}] AS text FROM documents"
_SHIPPED = f"WITH d AS ({_BELOW}) " + " UNION ALL ".join(
    f"SELECT doc_id, '{m.slug}' AS slug, '{m.tier}' AS tier FROM d WHERE ({' OR '.join(f'regexp_matches(text, $re${p}$re$)' for p in m.patterns)})" + (f" AND lower(ext) IN ({', '.join(map(repr, m.extensions))})" if m.extensions else "")
    for m in scan.MATCHERS
)


@query(_SHIPPED)
def scan_shipped(spark, d):
    """What the built-in matchers find in the documents, each with a line of code below it."""
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*map(F.lit, ("rs", "ts", "py", "RS"))), (F.floor(F.col("doc_id") / 16) % 4 + 1).cast("int"))
    line = F.element_at(F.array(*map(F.lit, LINES)), (F.col("doc_id") % len(LINES) + 1).cast("int"))
    files = docs.select("doc_id", F.concat(F.lit("src/f."), ext).alias("path"), F.concat("text", F.lit("\n"), line).alias("text"))
    return scan.candidates(files, "path", "text", id_col="doc_id").select("doc_id", "slug", "tier").distinct()


def _found(spark, d):
    return scan.candidates(table(spark, d, "documents"), "path", "text", DOC_MATCHERS, id_col="doc_id")


@query(f"WITH {_SCAN} SELECT doc_id, path, slug, tier, line FROM found")
def scan_candidates(spark, d):
    return _found(spark, d).select("doc_id", "path", "slug", "tier", "line")


@query(f"WITH {_SCAN} SELECT slug, CAST(count(*) AS BIGINT) AS matches, min(tier) AS tier FROM found GROUP BY 1")
def scan_slug_counts(spark, d):
    return scan.slug_counts(_found(spark, d))


#: Characters that the report of the scan may have.
BUDGET = 200_000


@query(f"""WITH {_SCAN}, seen AS (SELECT DISTINCT doc_id, path, slug, tier, line FROM found), shown_lines AS (SELECT s.*, left(trim(l.x, ' ' || chr(9) || chr(13)), 160) AS excerpt FROM seen s JOIN lines l USING (doc_id, path, line)),
per AS (SELECT path, min(CASE tier WHEN 'precise' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END) AS t, CAST(count(*) AS BIGINT) AS matches, sum(length('- ' || slug || ' line ' || line || ': ' || excerpt) + 1) + length(path) + 4 AS size FROM shown_lines GROUP BY 1),
run AS (SELECT *, CAST(row_number() OVER w AS BIGINT) AS place, sum(size) OVER w <= {BUDGET} AS shown FROM per WINDOW w AS (ORDER BY t, path ROWS UNBOUNDED PRECEDING)),
evidence AS (SELECT path, string_agg('- ' || slug || ' line ' || line || ': ' || excerpt, chr(10) ORDER BY line, slug, excerpt) AS full_text FROM shown_lines GROUP BY 1)
SELECT place, path, ['precise', 'normal', 'noisy'][t] AS tier, matches, CASE WHEN shown THEN '## ' || path || chr(10) || full_text ELSE '- ' || path || ': ' || matches || ' matches' END AS text, shown FROM run JOIN evidence USING (path)""")
def scan_payload(spark, d):
    return scan.payload(_found(spark, d), BUDGET)


def _candidates(spark, d):
    f = table(spark, d, "candidate_finding").groupBy("finding_id").agg(F.min(F.struct("path", "severity", "confidence", "line", "title", "created_at")).alias("s")).select("finding_id", "s.*")
    confidence = F.expr("try_cast(substring(finding_id, -2) AS int)")
    lens = F.substring_index("path", "/", 1)
    return f.where("path IS NOT NULL").select(lens.alias("lens"), F.expr("try_cast(substring(finding_id, 4) AS bigint)").alias("seq"), F.col("title").alias("slug"), "path", "line", F.lower("severity").alias("severity"), confidence.cast("long").alias("confidence"))


_CAND = """f AS (SELECT finding_id, min((path, severity, confidence, line, title, created_at)) AS s FROM candidate_finding GROUP BY 1),
cand AS (SELECT split_part(s[1], '/', 1) AS lens, try_cast(substr(finding_id, 4) AS BIGINT) AS seq, s[5] AS slug, s[1] AS path, s[4] AS line, lower(s[2]) AS severity, CAST(substr(finding_id, -2) AS BIGINT) AS confidence FROM f WHERE s[1] IS NOT NULL),
changed AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL),
kept AS (SELECT *, row_number() OVER (PARTITION BY lens, slug ORDER BY seq) AS rn FROM cand WHERE confidence >= 80 AND path IN (SELECT path FROM changed)),
few AS (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY seq) AS k FROM kept WHERE rn = 1), sel AS (SELECT * FROM few WHERE k <= 3)"""


@query(f"WITH {_CAND} SELECT lens, seq, path, lens || ':' || coalesce(slug, '') AS finding_id FROM sel")
def review_select(spark, d):
    return review.select(_candidates(spark, d), table(spark, d, "documents").where("path IS NOT NULL")).select("lens", "seq", "path", "finding_id")


@query(f"WITH {_CAND}, j AS (SELECT sel.*, v.verdict, v.ev FROM sel LEFT JOIN (SELECT try_cast(substr(lower(trim(finding_id)), 4) AS BIGINT) AS q, min_by(lower(verdict), record_id) AS verdict, min_by(trim(coalesce(evidence, '')), record_id) AS ev FROM finding_verdict WHERE verdict IS NOT NULL GROUP BY 1) v ON v.q = sel.seq) SELECT CAST(count(*) FILTER (WHERE verdict = 'confirmed' AND ev <> '') AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE verdict = 'refuted') AS BIGINT) AS refuted, CAST(count(*) FILTER (WHERE verdict IS NULL OR verdict NOT IN ('confirmed', 'refuted') OR verdict = 'confirmed' AND ev = '') AS BIGINT) AS unverified, CAST(count(*) FILTER (WHERE verdict = 'confirmed' AND ev <> '' AND severity IN ('critical', 'major')) AS BIGINT) AS high_priority FROM j")
def review_counts(spark, d):
    chosen = review.select(_candidates(spark, d), table(spark, d, "documents").where("path IS NOT NULL"))
    key = F.expr("try_cast(substring(lower(trim(finding_id)), 4) AS bigint)")
    v = table(spark, d, "finding_verdict").where("verdict IS NOT NULL").select(key.alias("q_"), F.col("record_id").alias("seq"), F.lower("verdict").alias("verdict"), F.lit(100).alias("confidence"), "evidence")
    v = v.join(chosen.select("finding_id", F.col("seq").alias("s_")), F.col("q_") == F.col("s_")).drop("q_", "s_")
    return review.counts(review.verify(chosen, v))


@query(f"WITH {_CAND} SELECT path, line, CAST(min(seq) AS BIGINT) AS first_seq, CAST(count(*) AS BIGINT) AS n FROM sel GROUP BY 1, 2")
def review_groups(spark, d):
    g = review.group(review.select(_candidates(spark, d), table(spark, d, "documents").where("path IS NOT NULL")))
    return g.select("path", "line", "first_seq", F.size("findings").cast("long").alias("n"))
