"""Several values packed in one field, to one row per value with its place.

The field is split on its quote characters: odd pieces are literals, even pieces are cut at the delimiters outside
brackets, and array folds put the values together again with their ordinals. Everything is a Spark SQL expression; the
only shuffle is the one that counts repeated deliveries once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks inside the fold. They take the place of delimiters, doubled quotes, and the ends of a literal.
CUT, QUOTE, OPEN, CLOSE = "\x01", "\x02", "\x03", "\x04"
SEPARATORS = r"[,;|\n\t]"
BRACKETS = r"[()<>\[\]{}]"
LIST_MARK = r"(?m)^[ \t]*(?:[-*•–]|\d{1,9}[.)])(?:[ \t]+|$)"
#: What a field says that has nothing to say.
NOTHING = ("", "none", "n/a", "na", "null", "nil", "-", "--", "–", "—", "[]", "{}", "()", '""')


@dataclass(frozen=True)
class Packed:
    """blanks: they separate where nothing else does. conjunction: a word that stands before the last value.
    typed: a value is a name with a type after it, of which the name counts."""

    field: str
    blanks: bool = False
    conjunction: str | None = None
    typed: bool = False


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def _delimited(p: str) -> str:
    """Delimiters of the piece ``p`` outside brackets as CUT. A bracket that nothing closes protects nothing."""
    sep, cut = _sql(SEPARATORS), _sql(CUT)
    plain = f"regexp_replace({p}, {sep}, {cut})"
    depth = "greatest(0, s.d + CASE WHEN rlike(t, '^[(<\\\\[{]') THEN 1 WHEN rlike(t, '^[)>\\\\]}]') THEN -1 ELSE 0 END)"
    fold = (
        f"aggregate(split({p}, {_sql(f'(?={BRACKETS})')}), named_struct('d', 0, 'o', ''), "
        f"(s, t) -> named_struct('d', {depth}, 'o', concat(s.o, if({depth} > 0, t, regexp_replace(t, {sep}, {cut})))), "
        f"s -> if(s.d > 0, {plain}, s.o))"
    )
    return f"if(rlike({p}, {_sql(BRACKETS)}), {fold}, {plain})"


def unpack(spec: Packed, column: str | None = None) -> Column:
    """array<string> of the values of a field, in order, repeated ones kept.

    Null, blank and nothing-saying fields give an empty array; so do fields of delimiters only. Quotes that do not
    pair are ordinary characters. JSON arrays are read as JSON, objects in them by their ``name``; text that only looks
    like one is unpacked like any other.
    """
    c = f"`{column or spec.field}`"
    sep = _sql(CUT)
    listed = f"rlike(t, {_sql(LIST_MARK)})"
    bare = f"trim(regexp_replace(t, {_sql(LIST_MARK)}, ''))"
    quotes = lambda x, q: f"(length({x}) - length(replace({x}, {_sql(q)}, '')))"

    def joined(outside: str) -> str:
        """Literals between their marks, everything outside through ``outside``."""
        return (
            f"array_join(transform(ps, (p, i) -> CASE WHEN i % 2 = 1 THEN concat({_sql(OPEN)}, p, {_sql(CLOSE)}) "
            f"WHEN p = '' AND i > 0 AND i < size(ps) - 1 THEN {_sql(QUOTE)} ELSE {outside} END), '')"
        )

    word = spec.conjunction
    outside = _delimited("p")
    if word:
        parted = f"regexp_replace(p, {_sql(rf'(?i)(?:^|(?<=[\s,;])|(?<=^))[,;]?\s*\b{word}\s+')}, {sep})"
        outside = f"if(rlike(p, {_sql(rf'(?i)(?:^|\s){word}\s')}), {_let('p', parted, outside)}, {outside})"
    cut = joined(outside)
    if spec.blanks:
        blank = joined(f"regexp_replace(p, '\\\\s+', {sep})")
        cut = _let("cut", cut, f"if(instr(cut, {sep}) = 0 AND NOT {listed}, {blank}, cut)")
    if spec.typed:
        value = (
            f"if(instr(v, {_sql(OPEN)}) > 0, regexp_extract(v, {_sql(f'(?s){OPEN}(.*){CLOSE}')}, 1), "
            f"regexp_replace(v, {_sql(r'(?s)\s*[:(].*$')}, ''))"
        )
    else:
        value = "v"
    clean = f"translate({value}, {_sql(OPEN + CLOSE)}, '')"
    clean = f"regexp_replace(replace({clean}, {_sql(QUOTE)}, '\"'), {_sql(r'(?U)^\s+|\s+$')}, '')"
    folded = f"filter(transform(split({cut}, {sep}, -1), v -> {clean}), v -> v <> '')"
    # A cut JSON array keeps its values; backquotes are quotes where they pair. Every step is bound once.
    folded = _let("ps", f"if({quotes('b', '\"')} % 2 = 0, split(b, '\"', -1), array(b))", folded)
    folded = _let("b", f"if({quotes('b', '`')} = 1, b, translate(b, '`', '\"'))", folded)
    folded = _let("b", f"regexp_replace({bare}, '^\\\\[', '')", folded)
    element = "trim(if(startswith(e, '{'), get_json_object(e, '$.name'), e))"
    from_json = f"filter(transform(j, e -> {element}), v -> v IS NOT NULL AND v <> '')"
    read = f"if(rlike(t, '^\\\\s*\\\\['), from_json(trim({c}), 'array<string>'), NULL)"
    either = _let("j", read, f"if(j IS NOT NULL, {from_json}, {folded})")
    nothing = f"t IS NULL OR lower(trim(t)) IN ({', '.join(map(_sql, NOTHING))})"
    return F.expr(_let("t", f"regexp_replace({c}, '\\\\r\\\\n?', '\\n')", f"if({nothing}, cast(array() AS array<string>), {either})"))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def unpack_fields(df: DataFrame, id_col: str, specs: list[Packed]) -> DataFrame:
    """(id, field_name, pos, item_value), pos from 1 without gaps; one scan of the table for all fields.

    Rows delivered twice count once. A null id is kept. Other columns of ``df`` play no part.
    """

    def placed(s: Packed) -> Column:
        return F.transform(unpack(s), lambda v, i: F.struct(F.lit(s.field).alias("field_name"), (i + 1).cast("long").alias("pos"), v.alias("item_value")))

    fields = F.array(*map(placed, specs))
    return df.select(id_col, *dict.fromkeys(s.field for s in specs)).select(id_col, F.inline(F.flatten(fields))).distinct()


#: The packed fields of results.
RESULT_FIELDS = [
    Packed("surface_ids", blanks=True, conjunction="and"),
    Packed("changed_paths", blanks=True),
    Packed("column_list", typed=True),
    Packed("coverage"),
]
