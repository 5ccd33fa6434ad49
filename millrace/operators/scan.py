"""Tiered pattern scan over a corpus of texts, and the report within a budget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine.running import running

EXCERPT = 160
TIERS = ("precise", "normal", "noisy")


@dataclass(frozen=True)
class Matcher:
    slug: str
    tier: str
    patterns: tuple[str, ...]
    extensions: tuple[str, ...] = ()


#: What is looked for. Matchers for a product's own mistakes are the caller's.
MATCHERS = (
    Matcher("secrets-exposure", "precise", (r'(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*"[A-Za-z0-9+/_\-]{16,}"',)),
    Matcher("graphql-injection", "precise", (r"(?s)format!\s*\([^;]{0,200}?(?:mutation|query)\s*\{",), ("rs",)),
    Matcher(
        "secret-in-fallback", "precise",
        (r'(?s)env(?:::var)?\s*\(\s*"[A-Z0-9_]*(KEY|SECRET|TOKEN|PASSWORD)[A-Z0-9_]*"\s*\)[^;\n]{0,120}unwrap_or', r"""process\.env\.[A-Z0-9_]*(KEY|SECRET|TOKEN|PASSWORD)[A-Z0-9_]*\s*(\|\||\?\?)\s*["'][^"'\n]{4,}["']"""),
        ("rs", "ts", "tsx", "js"),
    ),
    Matcher("insecure-crypto", "precise", (r"(?i)\b(md5|sha-?1)\s*(::|\()",)),
    Matcher(
        "secret-in-log", "normal",
        (r"(?i)(trace|debug|info|warn|error)!\s*\([^;\n]{0,160}(token|secret|password|api_key)", r"(?i)console\.(log|info|warn|error)\s*\([^;\n]{0,160}(token|secret|password|api_key)"),
        ("rs", "ts", "tsx", "js"),
    ),
    Matcher("command-injection", "normal", (r'(?s)Command::new\(\s*"(?:sh|bash|zsh)"\s*\)[^;]{0,120}?"-c"', r"\.args?\(\s*&?format!"), ("rs",)),
    Matcher("webhook-handler", "normal", (r"(?i)webhook",), ("rs", "ts", "tsx")),
    Matcher("path-traversal", "noisy", (r"\.join\(\s*&?[A-Za-z_]*(input|param|request|user|name|file|path|arg)[A-Za-z_]*\s*\)",), ("rs",)),
    Matcher("missing-auth", "noisy", (r'\.route\(\s*"', r"#\[(get|post|put|delete|patch)\("), ("rs",)),
)


def find(text: str, path: str, matchers: tuple[Matcher, ...] = MATCHERS) -> list[tuple[str, str, int, str]]:
    """(slug, tier, line, excerpt) of every match, one per slug and line. Lines are counted in one sweep per pattern."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    out, seen = [], set()
    for m in matchers:
        if m.extensions and ext not in m.extensions:
            continue
        for p in m.patterns:
            at, line = 0, 1
            for hit in re.compile(p).finditer(text):
                line += text.count("\n", at, hit.start())
                at = hit.start()
                if (m.slug, line) not in seen:
                    seen.add((m.slug, line))
                    start = text.rfind("\n", 0, at) + 1
                    stop = text.find("\n", at)
                    out.append((m.slug, m.tier, line, text[start : len(text) if stop < 0 else stop].strip()[:EXCERPT]))
    return out


def candidates(files: DataFrame, path_col: str = "path", text_col: str = "content", matchers: tuple[Matcher, ...] = MATCHERS, id_col: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(id, path, slug, tier, line, excerpt). Null texts and paths are not scanned, nor, where ``most_bytes`` is given,
    texts above it. Each text is scanned where it lies; patterns are compiled once a worker."""
    keep = [id_col] if id_col else []
    kind = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in keep)
    rows = files.where(F.col(path_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= most_bytes if most_bytes else F.lit(True))).select(*keep, F.col(path_col).alias("path"), F.col(text_col).alias("text_"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b[id_col] if id_col else [None] * len(b)
            out = [((i,) if id_col else ()) + (p, *x) for i, p, t in zip(ids, b["path"], b["text_"]) for x in find(t, p, matchers)]
            yield pd.DataFrame(out, columns=[*keep, "path", "slug", "tier", "line", "excerpt"])

    return rows.mapInPandas(run, f"{kind + ', ' if kind else ''}path string, slug string, tier string, line bigint, excerpt string")


def slug_counts(found: DataFrame) -> DataFrame:
    """(slug, matches, tier) with the best tier of each slug, most matches first."""
    best = F.array(*map(F.lit, TIERS))
    tier = F.min(F.array_position(best, F.col("tier")))
    out = found.groupBy("slug").agg(F.count(F.lit(1)).alias("matches"), F.element_at(best, tier.cast("int")).alias("tier"))
    return out.orderBy(F.desc("matches"), "slug")


def payload(found: DataFrame, most_chars: int) -> DataFrame:
    """(place, path, tier, matches, text, shown): a file's evidence in full while the running length of the files so far,
    best tier and then path first, keeps within ``most_chars``, else one line of inventory.

    Lengths run over one row per file without its text; evidence is gathered only for files that show it, which the budget
    bounds.
    """
    best = F.array(*map(F.lit, TIERS))
    line = F.concat(F.lit("- "), F.col("slug"), F.lit(" line "), F.col("line").cast("string"), F.lit(": "), F.col("excerpt"))
    # The heading and a line end follow; every line of evidence is set off by one.
    size = F.sum(F.length(line) + 1) + F.length("path") + 4
    per = found.groupBy("path").agg(F.min(F.array_position(best, F.col("tier"))).cast("int").alias("t_"), F.count(F.lit(1)).alias("matches"), size.alias("size_"))
    per = running(per, ["t_", "path"], "size_").withColumn("shown", F.col("before_") + F.col("size_") <= most_chars)
    few = per.where("shown").select("path")
    full = found.withColumn("s_", line).join(few, "path", "left_semi").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "slug", "s_"))), lambda x: x["s_"]), "\n").alias("full_"))
    short = F.concat(F.lit("- "), F.col("path"), F.lit(": "), F.col("matches").cast("string"), F.lit(" matches"))
    out = per.join(full, "path", "left")
    text = F.when(F.col("shown"), F.concat(F.lit("## "), "path", F.lit("\n"), "full_")).otherwise(short)
    return out.select(F.col("place_").cast("long").alias("place"), "path", F.element_at(best, F.col("t_")).alias("tier"), "matches", text.alias("text"), "shown")
