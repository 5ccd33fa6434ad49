"""Oversized items cut at natural boundaries: long texts, long page lists, and cursors that cut inside a line.

A text above the limit is split by a hierarchy of separators: page markers, headings, paragraphs, lines, sentences,
words, and characters last. Pieces of one level are packed greedily; one that alone exceeds the limit is split by the
next level. Every piece but the first begins with the end of the one before. Each text is cut where it lies, in time
linear in its length; nothing is shuffled.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine.batches import keyed, restored

LIMIT = 6_000
OVERLAP = 200
PAGES = 20
#: Rows that a task holds of a list of any length.
AT_ONCE = 10_000
#: Numbers of more digits are none.
DIGITS = 4_000

#: Where a text may be cut, best first: before a match of the first two, after a match of the others.
LEVELS = tuple(
    re.compile(p, re.M)
    for p in (
        r"^(?=<!-- (?:page|sheet) \d+ -->)",
        r"^(?=#{1,6}\s)",
        r"\n[ \t]*\n+",
        r"\n",
        r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])",
        r"\s+",
    )
)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _characters(text: str, limit: int) -> Iterator[str]:
    if text.isascii():
        for i in range(0, len(text), limit):
            yield text[i : i + limit]
        return
    start = n = 0
    for i, c in enumerate(text):
        b = 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        if n + b > limit:
            yield text[start:i]
            start, n = i, 0
        n += b
    yield text[start:]


def _bodies(text: str, limit: int, level: int = 0) -> Iterator[str]:
    """Consecutive parts of at most ``limit`` bytes that make up the text."""
    if _size(text) <= limit:
        yield text
        return
    if level == len(LEVELS):
        yield from _characters(text, limit)
        return
    held, n, at = [], 0, 0
    for end in [*(m.end() for m in LEVELS[level].finditer(text) if m.end() > 0), len(text)]:
        part, at = text[at:end], end
        if not part:
            continue
        size = _size(part)
        if n + size > limit and held:
            yield "".join(held)
            held, n = [], 0
        if size > limit:
            yield from _bodies(part, limit, level + 1)
        else:
            held.append(part)
            n += size
    if held:
        yield "".join(held)


def _tail(text: str, most: int) -> str:
    """The longest end of at most ``most`` bytes that begins a line, a sentence or a word, if there is one."""
    raw = text.encode("utf-8", "surrogatepass")[-most:] if most else b""
    while raw and raw[0] & 0xC0 == 0x80:
        raw = raw[1:]
    end = raw.decode("utf-8", "surrogatepass")
    if len(end) == len(text):
        return end
    for level in LEVELS[3:]:
        for m in level.finditer(end):
            if 0 < m.end() < len(end) and end[m.end() :].strip():
                return end[m.end() :]
    return end


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """(overlap, body) of each piece; the bodies joined are the text, and overlap and body together keep the limit."""
    if _size(text) <= limit:
        return [("", text)]
    out, before = [], ""
    for body in _bodies(text, limit - overlap):
        out.append((_tail(before, overlap) if before else "", body))
        before = body
    return out


def text_pieces(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, text, overlap_bytes, start_byte): the pieces of every text above ``limit`` bytes, counted from 1.

    text begins with overlap_bytes that the piece before ends with; start_byte is where the rest begins in the text.
    Texts within the limit, null and empty ones give nothing. Repeated rows give repeated pieces.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id_"], b["text_"]):
                start = 0
                for i, (before, body) in enumerate(split_text(text, limit, overlap), 1):
                    rows.append((key, i, before + body, _size(before), start))
                    start += _size(body)
            yield pd.DataFrame(rows, columns=["id_", "piece", "text", "overlap_bytes", "start_byte"])

    long = df.where(F.octet_length(text_col) > limit).select(keyed(id_col), F.col(text_col).alias("text_"))
    return restored(long.mapInPandas(run, f"id_ string, piece bigint, text string, overlap_bytes bigint, start_byte bigint"), id_col, kind)


_DASH = re.compile(r"\s*(?:[-‐‑‒–—−~]|\.\.+|\bto\b)\s*")
_RANGE = re.compile(r"(\d*)-(\d*)|(\d+)")


def page_spans(pages: str | None, page_count: int | None) -> list[tuple[int, int]]:
    """The pages named, as disjoint spans in order. A range without an end runs to the first or last page, one that
    runs backwards names the same pages; null or blank means all pages. What can't be told names none. Spans are told by
    their ends only, so that a range may be of any length."""
    count = page_count if page_count and page_count > 0 else 0
    if pages is None or not pages.strip():
        return [(1, count)] if count else []
    spans = []
    for a, b, one in _RANGE.findall(_DASH.sub("-", pages)):
        if max(map(len, (a, b, one))) > DIGITS:
            continue
        if one:
            lo = hi = int(one)
        elif a or b:
            lo, hi = int(a or 1), int(b or count)
            if not b and lo > hi:
                continue
        else:
            continue
        lo, hi = max(1, min(lo, hi)), max(lo, hi)
        spans.append((lo, hi))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def split_pages(spans: list[tuple[int, int]], most: int = PAGES) -> Iterator[list[tuple[int, int]]]:
    """Groups of at most ``most`` pages, in order, one after the other; a span is cut only where a group is full."""
    held, n = [], 0
    for lo, hi in spans:
        while lo <= hi:
            take = min(hi - lo + 1, most - n)
            held.append((lo, lo + take - 1))
            lo, n = lo + take, n + take
            if n == most:
                yield held
                held, n = [], 0
    if held:
        yield held


def page_ranges(df: DataFrame, id_col: str, pages_col: str, count_col: str, most: int = PAGES, upto: int | None = None) -> DataFrame:
    """(id, piece, pages, page_count): page lists of at most ``most`` pages each, in order, of every row that names
    pages. Rows that name none give nothing. A range gives as many rows as it asks for; with ``upto`` only so many of
    each row's first pieces are made, which is enough to tell what has more."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, pages, count in zip(b["id_"], b["pages_"], b["count_"]):
                groups = split_pages(page_spans(pages, None if pd.isna(count) else int(count)), most)
                for i, group in enumerate(islice(groups, upto), 1):
                    said = ",".join(str(lo) if lo == hi else f"{lo}-{hi}" for lo, hi in group)
                    rows.append((key, i, said, sum(hi - lo + 1 for lo, hi in group)))
                    if len(rows) == AT_ONCE:
                        yield pd.DataFrame(rows, columns=["id_", "piece", "pages", "page_count"])
                        rows = []
            yield pd.DataFrame(rows, columns=["id_", "piece", "pages", "page_count"])

    small = df.select(keyed(id_col), F.col(pages_col).alias("pages_"), F.col(count_col).cast("double").alias("count_"))
    return restored(small.mapInPandas(run, f"id_ string, piece bigint, pages string, page_count bigint"), id_col, kind)


_CURSOR = re.compile(r"ocr1\.([A-Za-z0-9_-]+)\.([0-9A-Za-z]+)")


def cursor_of(text: str | None) -> dict | None:
    """The object of a cursor, None where it is missing or unreadable."""
    m = _CURSOR.fullmatch((text or "").strip())
    if not m:
        return None
    try:
        x = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except ValueError:
        return None
    return x if isinstance(x, dict) else None


def open_cursors(df: DataFrame, id_col: str, cursor_col: str, complete_col: str) -> DataFrame:
    """(id, unit, position): incomplete rows whose cursor tells of a cut inside a line (``at.joint`` 0)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id_"], b["cursor_"]):
                at = (cursor_of(text) or {}).get("at")
                if isinstance(at, dict) and at.get("joint") == 0 and not isinstance(at.get("joint"), bool):
                    rows.append((key, *(v if isinstance(v := at.get(k), int) else None for k in ("unit", "pos"))))
            yield pd.DataFrame(rows, columns=["id_", "unit", "position"]).astype({"unit": "Int64", "position": "Int64"})

    some = df.where(~F.col(complete_col) & F.col(cursor_col).isNotNull()).select(keyed(id_col), F.col(cursor_col).alias("cursor_"))
    return restored(some.mapInPandas(run, f"id_ string, unit bigint, position bigint"), id_col, kind)
