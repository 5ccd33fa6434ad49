"""Queries of the text operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine.session import table
from millrace.llm import containers, leaks, neardup, pieces, quality, scans


def _scanned(spark: SparkSession, folder: str) -> list[scans.Part]:
    return [
        scans.Part(table(spark, folder, "ocr_page"), "OcrPage", "page_id", "markdown", page="page"),
        scans.Part(table(spark, folder, "ocr_document"), "OcrDocument", "record_id", "markdown", finished="is_complete"),
        scans.Part(table(spark, folder, "ocr_figure"), "OcrFigure", "figure_id", "text", paged=False),
    ]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.damaged_lines(_scanned(spark, folder))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired_texts(_scanned(spark, folder))


def p1_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Per record type: rows that name no line of their record, and lines that are furniture and damaged as well."""
    parts = _scanned(spark, folder)
    texts = scans.records(parts).groupBy("record_type", "record_id").agg(F.max(F.size(F.split("text", "\n", -1))).alias("n"))
    found = p1_found(spark, folder)
    lines = found.groupBy("record_type", "record_id", "line_no").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("damage").isin("running", "pageno")).alias("fixed"))
    joined = lines.hint("merge").join(texts.hint("merge"), ["record_type", "record_id"], "left")
    outside = F.coalesce((F.col("line_no") < 1) | (F.col("line_no") > F.col("n")), F.lit(True))
    return joined.groupBy("record_type").agg(F.sum(outside.cast("bigint")).alias("outside"), F.sum((F.col("fixed") & (F.col("k") > 1)).cast("bigint")).alias("doubled"))


_FINDING_TEXT = ("path", "title", "detail", "evidence")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.similar_pairs(table(spark, folder, "candidate_finding"), "finding_id", neardup.joined_text(*_FINDING_TEXT))
    return pairs.select(F.col("a").alias("finding_a"), F.col("b").alias("finding_b"))


def p2_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every finding with words, and the least of those that have the same words."""
    return neardup.members(table(spark, folder, "candidate_finding"), "finding_id", neardup.joined_text(*_FINDING_TEXT))


def p2_class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of such representatives."""
    pairs = neardup.class_pairs(table(spark, folder, "candidate_finding"), "finding_id", neardup.joined_text(*_FINDING_TEXT))
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "candidate_finding"), "finding_id", neardup.joined_text(*_FINDING_TEXT))


def p2_document_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share runs of five words, at a similarity of 0.8 or more."""
    return neardup.groups(table(spark, folder, "documents"), "doc_id", neardup.joined_text("text"), threshold=0.8, features=neardup.shingle_hashes(5))


def _paged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose ``pages`` names pages; in workbooks it names a sheet."""
    return table(spark, folder, "ocr_document").where(~F.coalesce(F.lower("file_format"), F.lit("")).isin("xlsx", "ods"))


def p4_page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Page lists of at most 20 pages for every document that asks for more."""
    ranges = pieces.page_ranges(_paged(spark, folder), "record_id", "pages", "page_count").distinct()
    return ranges.join(ranges.where("piece = 2").select("record_id"), "record_id", "left_semi")


def p4_text_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.text_pieces(table(spark, folder, "ocr_document"), "record_id", "markdown").distinct()


def p4_text_whole(spark: SparkSession, folder: str) -> DataFrame:
    """For every text that was cut: the digest of its pieces without their overlaps, put together again in order, and
    whether all pieces keep the limit and every overlap."""
    pieces_ = pieces.text_pieces(table(spark, folder, "ocr_document"), "record_id", "markdown").distinct()
    body = F.expr("decode(substring(encode(text, 'UTF-8'), CAST(overlap_bytes AS INT) + 1), 'UTF-8')")
    each = pieces_.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("piece", body.alias("body")))).alias("s"), (F.max(F.octet_length("text")) <= pieces.LIMIT).alias("within"), (F.max("overlap_bytes") <= pieces.OVERLAP).alias("overlaps")
    )
    return each.select("record_id", F.md5(F.array_join(F.col("s.body"), "")).alias("digest"), "within", "overlaps")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "ocr_document")
    parts = (
        ("pages", pieces.page_ranges(_paged(spark, folder), "record_id", "pages", "page_count", upto=2).where("piece = 2")),
        ("markdown", pieces.text_pieces(documents, "record_id", "markdown").where("piece = 2")),
        ("next_cursor", pieces.open_cursors(documents, "record_id", "next_cursor", "is_complete")),
    )
    found = [df.select("record_id", F.lit(name).alias("field_name")) for name, df in parts]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container and place of every document that isn't blank."""
    return containers.fill_documents(table(spark, folder, "documents"))


def p7_placed(spark: SparkSession, folder: str) -> DataFrame:
    """For every document that was placed: whether its pieces follow one another without a gap, whether its containers
    keep their room, and whether it was left whole where that could be."""
    placed = p7_containers(spark, folder)
    full = placed.groupBy("container").agg(F.sum("size").alias("filled"))
    each = placed.join(full, "container").groupBy("doc_id").agg(
        F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("end"), F.min("start").alias("begin"), F.count(F.lit(1)).alias("n"), F.max("filled").alias("filled")
    )
    whole = (F.col("begin") == 0) & (F.col("end") == F.col("size"))
    return each.select("doc_id", whole.alias("complete"), (F.col("filled") <= containers.CAPACITY).alias("within"), ((F.col("n") == 1) | (F.col("size") > containers.CAPACITY)).alias("left_whole"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of room used."""
    each = p7_containers(spark, folder).groupBy("container").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * containers.CAPACITY), 6).alias("used"),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id").distinct()


def p8_longest(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per test item: the documents that give it away and the longest run of its words."""
    found = leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("matched_words").alias("longest_words"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return leaks.without_leaks(documents, leaks.find_leaks(documents, table(spark, folder, "eval_item"))).select("doc_id", "lang", "source")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(table(spark, folder, "documents"), lang_col="lang")


_STATISTICS = ("doc_id", "char_count", "word_count", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(quality.text_quality(table(spark, folder, "documents"), lang_col="lang").select(*_STATISTICS))


def p9_statistics_in_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same by chunks of 500 characters, so that most texts are split and merged."""
    return _rounded(quality.text_quality(table(spark, folder, "documents"), chunk=500, lang_col="lang").select(*_STATISTICS))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of every document's characters in lists, tables and junk, and its kind."""
    return quality.text_quality(table(spark, folder, "documents"), lang_col="lang").select("doc_id", "list_share", "table_share", "junk_share", "kind")


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p1_consistent": p1_consistent,
    "p2_found": p2_found,
    "p2_members": p2_members,
    "p2_class_pairs": p2_class_pairs,
    "p2_groups": p2_groups,
    "p2_document_groups": p2_document_groups,
    "p4_found": p4_found,
    "p4_page_ranges": p4_page_ranges,
    "p4_text_pieces": p4_text_pieces,
    "p4_text_whole": p4_text_whole,
    "p7_containers": p7_containers,
    "p7_placed": p7_placed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_longest": p8_longest,
    "p8_leaked_items": p8_leaked_items,
    "p8_clean": p8_clean,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
    "p9_statistics_in_chunks": p9_statistics_in_chunks,
    "p9_shares": p9_shares,
}
#: Words as lists, in DuckDB; only ASCII letters change case.
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"

_RUNS = f"""
runs AS (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS run FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL))),
grams AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS run FROM (
    SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_item WHERE text IS NOT NULL))),
leaked AS (SELECT DISTINCT doc_id, item_id FROM runs JOIN grams USING (run))"""

_RUNS_AT = f"""
at_doc AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 11), ' ') AS run FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL))),
at_item AS (
  SELECT item_id, j, array_to_string(list_slice(w, j, j + 11), ' ') AS run FROM (
    SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_item WHERE text IS NOT NULL))),
islands AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM at_doc JOIN at_item USING (run)),
shared AS (SELECT doc_id, item_id, count(*) + 11 AS matched_words, min(i) AS doc_start, min(j) AS item_start FROM islands GROUP BY doc_id, item_id, i - j, g),
longest AS (SELECT doc_id, item_id, matched_words, doc_start, item_start FROM shared
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched_words DESC, doc_start, item_start) = 1)"""

_SHINGLES = f"""
words AS (SELECT DISTINCT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS s FROM words WHERE len(w) > 0),
members AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep, s FROM sets),
parts AS (SELECT DISTINCT rep, len(s) AS n, unnest(s) AS t FROM members),
class_pairs AS (
  SELECT x.rep AS a, y.rep AS b FROM parts x JOIN parts y ON x.t = y.t AND x.rep < y.rep
  GROUP BY 1, 2 HAVING 10 * count(*) >= 8 * (any_value(x.n) + any_value(y.n) - count(*))),
edges AS (SELECT a, b FROM class_pairs UNION ALL SELECT b, a FROM class_pairs)"""

_NAMED_PAGES = """
tokens AS (
  SELECT record_id, page_count, unnest(regexp_extract_all(regexp_replace(pages, '\\s*[-–—]\\s*', '-', 'g'), '[0-9]*-[0-9]*|[0-9]+')) AS t
  FROM ocr_document WHERE file_format NOT IN ('xlsx', 'ods') AND trim(pages) <> ''),
ends AS (
  SELECT record_id, CASE WHEN contains(t, '-') THEN coalesce(try_cast(split_part(t, '-', 1) AS BIGINT), 1) ELSE CAST(t AS BIGINT) END AS a,
    CASE WHEN contains(t, '-') THEN coalesce(try_cast(split_part(t, '-', 2) AS BIGINT), page_count, 0) ELSE CAST(t AS BIGINT) END AS b,
    contains(t, '-') AND split_part(t, '-', 2) = '' AS opened
  FROM tokens WHERE t <> '-'),
named AS (
  SELECT record_id, count(DISTINCT p) AS n FROM (
    SELECT record_id, unnest(generate_series(least(a, b), greatest(a, b))) AS p FROM ends WHERE NOT (opened AND a > b)) GROUP BY record_id
  UNION ALL SELECT record_id, page_count FROM ocr_document WHERE file_format NOT IN ('xlsx', 'ods') AND coalesce(trim(pages), '') = '')"""

_REACH = """
reach(node, root) AS (SELECT a, a FROM edges UNION SELECT e.a, r.root FROM reach r JOIN edges e ON e.b = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degree AS (SELECT a AS rep, count(*) AS links FROM edges GROUP BY a)"""

_CLASSES = f"""
sets AS (SELECT finding_id, list_sort(list_distinct({_WORDS.format("concat_ws(' ', coalesce(path, ''), coalesce(title, ''), coalesce(detail, ''), coalesce(evidence, ''))")})) AS w FROM candidate_finding WHERE finding_id IS NOT NULL),
members AS (SELECT DISTINCT finding_id, min(finding_id) OVER (PARTITION BY w) AS rep, w FROM sets WHERE len(w) > 0),
words AS (SELECT DISTINCT rep, len(w) AS n, unnest(w) AS t FROM members),
class_pairs AS (
  SELECT x.rep AS a, y.rep AS b, count(*) AS k, any_value(x.n) + any_value(y.n) - count(*) AS whole FROM words x JOIN words y ON x.t = y.t AND x.rep < y.rep
  GROUP BY 1, 2 HAVING 10 * count(*) >= 6 * whole),
edges AS (SELECT a, b FROM class_pairs UNION ALL SELECT b, a FROM class_pairs)"""

_ALIKE = f"""
sets AS (SELECT DISTINCT finding_id, {_WORDS.format("concat_ws(' ', coalesce(path, ''), coalesce(title, ''), coalesce(detail, ''), coalesce(evidence, ''))")} AS w FROM candidate_finding),
tokens AS (SELECT DISTINCT finding_id, unnest(w) AS t FROM sets),
sizes AS (SELECT finding_id, count(*) AS n FROM tokens GROUP BY finding_id),
common AS (SELECT a.finding_id AS finding_a, b.finding_id AS finding_b, count(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t AND a.finding_id < b.finding_id GROUP BY ALL),
alike AS (
  SELECT finding_a, finding_b FROM common JOIN sizes x ON x.finding_id = finding_a JOIN sizes y ON y.finding_id = finding_b
  WHERE 10 * k >= 6 * (x.n + y.n - k))"""

_QUALITY = """
texts AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\x{a0}]')) AS lines FROM documents WHERE text IS NOT NULL),
docs AS (SELECT lang, greatest(5, 0.2 * count(*)) AS least FROM texts WHERE lang IS NOT NULL GROUP BY lang),
has AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_distinct(list_transform(words, lambda x: lower(x)))) AS w FROM texts) GROUP BY ALL),
common AS (SELECT DISTINCT w FROM has JOIN docs USING (lang) WHERE n >= least AND NOT regexp_full_match(w, '\\p{N}+')),
listed AS (SELECT coalesce(list(w), []) AS c FROM common)
SELECT doc_id, length(replace(text, chr(10), '')) AS char_count, len(words) AS word_count,
  CASE WHEN len(words) > 0 THEN round(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / len(words), 9) END AS mean_word_length,
  CASE WHEN length(replace(text, chr(10), '')) > 0 THEN round(length(regexp_replace(text, '[\\p{L}\\p{N} \\t\\r\\n\\x{a0}]', '', 'g')) / length(replace(text, chr(10), '')), 9) END AS symbol_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…。！？]\\s*$'))) / len(lines), 9) END AS punctuated_line_share,
  CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda x: list_contains(c, lower(x)))) / len(words), 9) END AS common_word_share
FROM texts, listed"""

_PAGE_LISTS = f"""
each AS (
  SELECT DISTINCT record_id, p FROM (
    SELECT record_id, unnest(generate_series(least(a, b), greatest(a, b))) AS p FROM ends WHERE NOT (opened AND a > b)
    UNION ALL SELECT record_id, unnest(generate_series(1, page_count)) FROM ocr_document WHERE file_format NOT IN ('xlsx', 'ods') AND coalesce(trim(pages), '') = '') WHERE p > 0),
placed AS (SELECT record_id, p, row_number() OVER (PARTITION BY record_id ORDER BY p) AS k, count(*) OVER (PARTITION BY record_id) AS n FROM each),
spans AS (SELECT record_id, (k - 1) // 20 + 1 AS piece, min(p) AS lo, max(p) AS hi, count(*) AS m FROM placed WHERE n > 20 GROUP BY record_id, piece, p - k)"""

SQL: dict[str, str] = {
    "p1_consistent": "SELECT unnest(['OcrDocument', 'OcrFigure', 'OcrPage']) AS record_type, 0 AS outside, 0 AS doubled",
    "p2_document_groups": f"""
WITH RECURSIVE {_SHINGLES}, {_REACH}, sized AS (SELECT rep, count(*) AS n FROM members GROUP BY rep)
SELECT doc_id, coalesce(root, rep) AS group_id, coalesce(links, 0) AS links
FROM members JOIN sized USING (rep) LEFT JOIN roots ON node = rep LEFT JOIN degree USING (rep) WHERE root IS NOT NULL OR n > 1""",
    "p4_page_ranges": f"""
WITH {_NAMED_PAGES}, {_PAGE_LISTS}
SELECT record_id, piece, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS pages, CAST(sum(m) AS BIGINT) AS page_count FROM spans GROUP BY record_id, piece""",
    "p4_text_whole": "SELECT DISTINCT record_id, md5(markdown) AS digest, true AS within, true AS overlaps FROM ocr_document WHERE strlen(markdown) > 6000",
    "p7_placed": "SELECT doc_id, true AS complete, true AS within, true AS left_whole FROM documents WHERE regexp_matches(text, '[^\\s\\x{a0}]')",
    "p8_longest": f"WITH {_RUNS_AT} SELECT * FROM longest",
    "p8_leaked_items": f"WITH {_RUNS_AT} SELECT item_id, count(DISTINCT doc_id) AS documents, max(matched_words) AS longest_words FROM longest GROUP BY item_id",
    "p2_found": f"WITH {_ALIKE} SELECT finding_a, finding_b FROM alike",
    "p2_members": f"WITH {_CLASSES} SELECT finding_id, rep AS representative FROM members",
    "p2_class_pairs": f"WITH {_CLASSES} SELECT a, b, round(k / whole, 9) AS similarity FROM class_pairs",
    "p2_groups": f"""
WITH RECURSIVE {_CLASSES}, {_REACH}, sized AS (SELECT rep, count(*) AS n FROM members GROUP BY rep)
SELECT finding_id, coalesce(root, rep) AS group_id, coalesce(links, 0) AS links
FROM members JOIN sized USING (rep) LEFT JOIN roots ON node = rep LEFT JOIN degree USING (rep) WHERE root IS NOT NULL OR n > 1""",
    "p4_found": f"""
WITH {_NAMED_PAGES},
cursors AS (
  SELECT record_id, regexp_extract(next_cursor, '^ocr1[.]([A-Za-z0-9_-]+)[.][0-9a-zA-Z]+$', 1) AS c FROM ocr_document WHERE is_complete = false),
bodies AS (
  SELECT record_id, decode(from_base64(rpad(translate(c, '-_', '+/'), CAST(4 * ceil(length(c) / 4.0) AS INT), '='))) AS j FROM cursors WHERE c <> '')
SELECT DISTINCT record_id, 'pages' AS field_name FROM named WHERE n > 20
UNION SELECT record_id, 'markdown' FROM ocr_document WHERE strlen(markdown) > 6000
UNION SELECT record_id, 'next_cursor' FROM bodies WHERE regexp_matches(j, '"at":[{{][^}}]*"joint":0[,}}]')""",
    "p8_found": f"WITH {_RUNS} SELECT doc_id, item_id FROM leaked",
    "p9_statistics": f"WITH {_QUALITY}",
    "p9_statistics_in_chunks": f"WITH {_QUALITY}",
    "p8_clean": f"WITH {_RUNS} SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaked)",
}
