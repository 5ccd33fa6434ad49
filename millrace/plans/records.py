"""Queries over delivered records: orphan references, nested documents, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine.session import table
from millrace.operators import orphans, packed, shred


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    finding, dispatch, work, completion, verdict = (table(spark, folder, t) for t in ("candidate_finding", "dispatch", "work_result", "completion", "finding_verdict"))
    of = lambda kind: completion.where(F.col("record_type") == kind)
    return orphans.find_orphans(
        [
            orphans.Child(verdict, "FindingVerdict", "finding", "finding_id"),
            orphans.Child(of("InvestigationResult"), "InvestigationResult", "batch", "batch_id"),
            orphans.Child(of("PortUnitClosure"), "PortUnitClosure", "implementation", "implementation_id"),
            orphans.Child(of("DefenseVerificationCompletion"), "DefenseVerificationCompletion", "assignment", "assignment_id"),
        ],
        [
            orphans.Parent(finding, "finding", "finding_id"),
            orphans.Parent(dispatch, "batch", "batch_id"),
            orphans.Parent(dispatch, "assignment", "assignment_id"),
            orphans.Parent(work, "implementation", "implementation_id"),
        ],
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("record_type", "record_id", "created_month", "reason")


def p3_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.count_orphans(p3_found(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    flat = shred.flatten(table(spark, folder, "plugin_case"), "case_id", "doc", shred.CALL, shred.CALL_TABLES)
    return flat.select("case_id", "entity", "parent_pos", "pos").distinct()


def p5_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Entries per leaf path and level pair, a document delivered twice counted once."""
    levels = shred.shred_levels(table(spark, folder, "plugin_case").dropDuplicates(["case_id"]), "case_id", "doc", shred.CALL)
    return levels.groupBy("path", "repetition", "definition").agg(F.count(F.lit(1)).alias("entries"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed.unpack_fields(table(spark, folder, "work_result"), "record_id", packed.RESULT_FIELDS)


def p6_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each packed value occurs, over all fields."""
    return p6_found(spark, folder).groupBy("field_name", "item_value").agg(F.count(F.lit(1)).alias("uses"))


_KEY = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_P3_ROWS = f"""
refs AS (
  SELECT 'FindingVerdict' AS record_type, record_id, 'finding' AS t, {_KEY.format('finding_id')} AS k, created_at AS at_t FROM finding_verdict
  UNION ALL SELECT record_type, record_id, CASE record_type WHEN 'InvestigationResult' THEN 'batch' WHEN 'PortUnitClosure' THEN 'implementation' ELSE 'assignment' END,
    CASE record_type WHEN 'InvestigationResult' THEN {_KEY.format('batch_id')} WHEN 'PortUnitClosure' THEN {_KEY.format('implementation_id')} ELSE {_KEY.format('assignment_id')} END, created_at
  FROM completion WHERE record_type IN ('InvestigationResult', 'PortUnitClosure', 'DefenseVerificationCompletion')),
parents AS (
  SELECT 'finding' AS t, {_KEY.format('finding_id')} AS k, created_at AS c, deleted_at AS d FROM candidate_finding
  UNION ALL SELECT 'batch', {_KEY.format('batch_id')}, created_at, deleted_at FROM dispatch
  UNION ALL SELECT 'assignment', {_KEY.format('assignment_id')}, created_at, deleted_at FROM dispatch
  UNION ALL SELECT 'implementation', {_KEY.format('implementation_id')}, created_at, deleted_at FROM work_result),
judged AS (
  SELECT r.record_type, r.record_id, r.at_t, count(p.k) AS known, coalesce(bool_or(p.c <= r.at_t), false) AS seen,
    coalesce(bool_or(p.c <= r.at_t AND (p.d IS NULL OR p.d > r.at_t)), false) AS held
  FROM (SELECT DISTINCT * FROM refs WHERE k <> '') r LEFT JOIN parents p ON p.t = r.t AND p.k = r.k
  GROUP BY r.record_type, r.record_id, r.t, r.k, r.at_t),
found AS (
  SELECT DISTINCT record_type, record_id, strftime(at_t, '%Y-%m') AS created_month,
    CASE WHEN known = 0 THEN 'missing' WHEN NOT seen THEN 'late' ELSE 'deleted' END AS reason FROM judged WHERE NOT held)"""



def _dec(x: str) -> str:
    """A JSON member, or the value its text encodes."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[\\[{{]') AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END"


def _items(x: str) -> str:
    """Elements of a repeated member; an object is its only one."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


_SOME = "{0} IS NOT NULL AND json_type({0}) <> 'NULL'"
_P5_ROWS = f"""
docs AS (SELECT DISTINCT case_id, j FROM (SELECT case_id, try_cast(ltrim(doc, chr(65279)) AS JSON) AS j FROM plugin_case) WHERE json_type(j) = 'OBJECT'),
parts AS (SELECT case_id, {_dec("(j -> '$.input.caller')")} AS caller, {_dec("(j -> '$.input.data')")} AS data, {_dec("(j -> '$.expect.progress')")} AS p1, {_dec("(j -> '$.expect.effects.progress')")} AS p2 FROM docs),
progress AS (SELECT case_id, CASE WHEN {_SOME.format('p1')} THEN p1 ELSE p2 END AS p FROM parts),
sets AS (SELECT case_id, unnest(l) AS d, generate_subscripts(l, 1) AS i FROM (SELECT case_id, {_items('data')} AS l FROM parts)),
rows_ AS (SELECT case_id, i, unnest(l) AS e, generate_subscripts(l, 1) AS k FROM (SELECT case_id, i, {_items('r')} AS l FROM (SELECT case_id, i, {_dec("(d -> '$.rows')")} AS r FROM sets))),
phases AS (SELECT case_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT case_id, {_items('f')} AS l FROM (SELECT case_id, {_dec("(p -> '$.phases')")} AS f FROM progress))),
slots AS (SELECT case_id, i, unnest(l) AS e, generate_subscripts(l, 1) AS k FROM (SELECT case_id, i, {_items('a')} AS l FROM (SELECT case_id, i, {_dec("(e -> '$.active')")} AS a FROM phases)))
SELECT case_id, 'caller' AS entity, CAST(0 AS BIGINT) AS parent_pos, CAST(1 AS BIGINT) AS pos FROM parts WHERE json_type(caller) = 'OBJECT' AND {_SOME.format("(caller -> '$.agent_id')")}
UNION SELECT case_id, 'data_row', i, k FROM rows_ WHERE {_SOME.format('e')}
UNION SELECT case_id, 'progress', 0, 1 FROM progress WHERE json_type(p) = 'OBJECT' AND {_SOME.format("(p -> '$.state')")}
UNION SELECT case_id, 'phase', 1, i FROM phases WHERE {_SOME.format('e')}
UNION SELECT case_id, 'slot', i, k FROM slots WHERE {_SOME.format('e')}"""

#: Packed fields in DuckDB, told apart by whole-value patterns instead of quote pieces.
_MARK = "(?m)^[ \\t]*(?:[-*•–]|[0-9]{1,9}[.)])(?:[ \\t]+|$)"
_ITEM = '(?:"(?:[^"]|"")*"|[(][^)]*[)]|<[^>]*>|[^,;|\\n\\t"(<])+'
_WORD = '(?:"(?:[^"]|"")*"|[^\\s"])+'
_P6_ROWS = f"""
fields AS (
  SELECT DISTINCT record_id, f.field_name, regexp_replace(f.v, '\\r\\n?', chr(10), 'g') AS v FROM work_result,
  LATERAL (VALUES ('surface_ids', surface_ids), ('changed_paths', changed_paths), ('column_list', column_list), ('coverage', coverage)) f(field_name, v) WHERE f.v IS NOT NULL AND lower(trim(f.v)) NOT IN ('', 'none', 'n/a', '-', '[]')),
parsed AS (
  SELECT record_id, field_name, CASE WHEN v LIKE '[%' AND json_valid(v) THEN list_transform(json_extract(v, '$[*]'), lambda e: CASE WHEN json_type(e) = 'OBJECT' THEN e ->> '$.name' ELSE e ->> '$' END) END AS j,
    regexp_matches(v, '{_MARK}') AS listed, regexp_replace(replace(regexp_replace(v, '{_MARK}', '', 'g'), '`', '"'), CASE WHEN field_name = 'surface_ids' THEN '\\s+and\\s+' ELSE '^$' END, ',', 'g') AS b FROM fields),
cut AS (SELECT *, CASE WHEN j IS NOT NULL THEN j WHEN field_name IN ('surface_ids', 'changed_paths') AND NOT listed AND len(regexp_extract_all(b, '{_ITEM}')) = 1 AND NOT regexp_matches(b, '^[,;|\\n\\t]|[,;|\\n\\t]$') THEN regexp_extract_all(b, '{_WORD}') ELSE regexp_extract_all(b, '{_ITEM}') END AS l FROM parsed),
cleaned AS (
  SELECT record_id, field_name, list_filter(list_transform(l, lambda x: trim(CASE WHEN j IS NOT NULL THEN x WHEN field_name = 'column_list' AND contains(x, '"') THEN replace(regexp_extract(x, '"((?:[^"]|"")*)"', 1), '""', '"')
    WHEN field_name = 'column_list' THEN regexp_replace(x, '\\s*[:(](?s:.*)$', '') WHEN contains(x, '"') THEN replace(regexp_replace(trim(x), '^"(.*)"$', '\\1'), '""', '"') ELSE x END)), lambda x: x <> '') AS l FROM cut)
SELECT DISTINCT record_id, field_name, CAST(pos AS BIGINT) AS pos, item_value FROM (SELECT record_id, field_name, unnest(l) AS item_value, generate_subscripts(l, 1) AS pos FROM cleaned)"""

_VALUE = "{0} IS NOT NULL AND json_type({0}) <> 'NULL'"
#: Level entries from the members themselves: a list without elements gives one entry of its parent's definition.
_P5_LEVELS = f"""
one AS (SELECT case_id, doc FROM (SELECT case_id, doc, row_number() OVER (PARTITION BY case_id) AS k FROM plugin_case) WHERE k = 1),
docs AS (SELECT case_id, j FROM (SELECT case_id, try_cast(ltrim(doc, chr(65279)) AS JSON) AS j FROM one) WHERE json_type(j) = 'OBJECT'),
parts AS (SELECT case_id, {_dec("(j -> '$.input.caller')")} AS caller, {_dec("(j -> '$.input.data')")} AS data, {_dec("(j -> '$.expect.progress')")} AS p1, {_dec("(j -> '$.expect.effects.progress')")} AS p2 FROM docs),
progress AS (SELECT case_id, CASE WHEN {_VALUE.format('p1')} THEN p1 ELSE p2 END AS p FROM parts),
sets AS (SELECT case_id, l, len(l) AS n FROM (SELECT case_id, {_items('data')} AS l FROM parts)),
set_ AS (SELECT case_id, unnest(l) AS d, generate_subscripts(l, 1) AS i FROM sets),
rows_ AS (SELECT case_id, i, {_items('r')} AS l FROM (SELECT case_id, i, {_dec("(d -> '$.rows')")} AS r FROM set_)),
row_ AS (SELECT case_id, i, unnest(l) AS e, generate_subscripts(l, 1) AS k FROM rows_),
phases AS (SELECT case_id, {_items('f')} AS l, {_VALUE.format('p')} AND json_type(p) = 'OBJECT' AS has FROM (SELECT case_id, p, {_dec("(p -> '$.phases')")} AS f FROM progress)),
phase_ AS (SELECT case_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM phases),
slots AS (SELECT case_id, i, e, {_items('a')} AS l FROM (SELECT case_id, i, e, {_dec("(e -> '$.active')")} AS a FROM phase_)),
slot_ AS (SELECT case_id, i, unnest(l) AS e, generate_subscripts(l, 1) AS k FROM slots),
entries AS (
  SELECT 'call.caller.agent_id' AS path, 0 AS repetition, CASE WHEN NOT coalesce(json_type(caller) = 'OBJECT', false) THEN 1 WHEN {_VALUE.format("(caller -> '$.agent_id')")} THEN 3 ELSE 2 END AS definition FROM parts
  UNION ALL SELECT 'call.progress.state', 0, CASE WHEN NOT coalesce(json_type(p) = 'OBJECT', false) THEN 1 WHEN {_VALUE.format("(p -> '$.state')")} THEN 3 ELSE 2 END FROM progress
  UNION ALL SELECT 'call.data.rows.element', 0, 1 FROM sets WHERE coalesce(n, 0) = 0
  UNION ALL SELECT 'call.data.rows.element', CASE WHEN i = 1 THEN 0 ELSE 1 END, 2 FROM rows_ WHERE coalesce(len(l), 0) = 0
  UNION ALL SELECT 'call.data.rows.element', CASE WHEN k > 1 THEN 2 WHEN i > 1 THEN 1 ELSE 0 END, CASE WHEN {_VALUE.format('e')} THEN 4 ELSE 3 END FROM row_
  UNION ALL SELECT 'call.progress.phases.element', 0, CASE WHEN has THEN 2 ELSE 1 END FROM phases WHERE coalesce(len(l), 0) = 0
  UNION ALL SELECT 'call.progress.phases.element', CASE WHEN i > 1 THEN 1 ELSE 0 END, CASE WHEN {_VALUE.format('e')} THEN 4 ELSE 3 END FROM phase_
  UNION ALL SELECT 'call.progress.phases.active.element', 0, CASE WHEN has THEN 2 ELSE 1 END FROM phases WHERE coalesce(len(l), 0) = 0
  UNION ALL SELECT 'call.progress.phases.active.element', CASE WHEN i > 1 THEN 1 ELSE 0 END, 3 FROM slots WHERE coalesce(len(l), 0) = 0
  UNION ALL SELECT 'call.progress.phases.active.element', CASE WHEN k > 1 THEN 2 WHEN i > 1 THEN 1 ELSE 0 END, CASE WHEN {_VALUE.format('e')} THEN 5 ELSE 4 END FROM slot_)"""

QUERIES = {
    "p3_found": p3_found,
    "p3_orphan_counts": p3_orphan_counts,
    "p5_found": p5_found,
    "p5_levels": p5_levels,
    "p6_found": p6_found,
    "p6_value_counts": p6_value_counts,
}
SQL = {
    "p5_levels": f"WITH {_P5_LEVELS} SELECT path, repetition, definition, count(*) AS entries FROM entries GROUP BY ALL",
    "p5_found": f"WITH {_P5_ROWS}",
    "p6_found": f"WITH {_P6_ROWS}",
    "p6_value_counts": f"SELECT field_name, item_value, count(*) AS uses FROM (WITH {_P6_ROWS}) GROUP BY 1, 2",
    "p3_found": f"WITH {_P3_ROWS} SELECT * FROM found",
    "p3_orphan_counts": f"WITH {_P3_ROWS} SELECT record_type, created_month, reason, count(*) AS orphan_count FROM found GROUP BY ALL",
}
