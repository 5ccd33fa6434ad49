"""Per-document text statistics, and documents that are no prose.

Huge documents are split into chunks of ``CHUNK`` characters, each with some context on either side. A chunk gives
associative partial counts: sums over the lines it holds whole, and the features of the line it begins and the line it
ends inside. Merging two neighbours adds the sums and joins the last line of the one with the first of the other, whose
class is only decided once the line is whole; so any split gives what the unsplit text gives. Partials are merged as a
tree of ``FAN`` each, which bounds what one task holds of a document of any length. Documents of one chunk, nearly all,
need no shuffle.

Which words are common, and which letter pairs are usual in words, is learned from all documents beforehand. The rules by
which a line is of a list, a table or junk are parameters of the code (``line_class``).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine.batches import keyed, restored
from millrace.engine.session import Scratch

CHUNK = 8_192
#: Context on either side, more than any word that counts is long.
CONTEXT = 1_024
#: Partials merged at once; two levels reach beyond the longest text a column can hold.
FAN, LEVELS = 1_024, 2

#: A word is common when at least this share of a language's documents has it, and at least so many of them.
COMMON_SHARE, LEAST_DOCUMENTS = 0.2, 5
#: A letter pair is usual when it makes up at least this share of the pairs in words of several documents.
USUAL_SHARE, SEVERAL = 1 / 2000, 3

_WORD = re.compile(r"[^\W_]+")
#: The same in lower-cased ASCII text.
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
_MARKED = re.compile(r"\s*(?:[-*+•–]\s+(?:\[[ xX]?\]\s+)?|\(?\d{1,4}[.)]\s+|\(?[a-z][.)]\s+)\S")
_NAMED = re.compile(r"[\w][\w .\-/]{0,48}\s*[:=]\s*\S.{0,90}$|[\w][\w .\-/]{0,48}:$")
_PATH = re.compile(r"[\w.\-]+(?:[/\\][\w.\- ]+)+$")
_HTML_CELL = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_COLUMNS = re.compile(r"\S(?: {2,}(?=\S)|\t)")
_HEX = re.compile(r"[0-9a-fA-F]{6,16}[:\s](?:\s*[0-9a-fA-F]{2,8}\b){4}")
_CODED = re.compile(r"[A-Za-z0-9+/=_\-]{32,}")
_GARBLED = re.compile("[ÂÃÅ�\u0080-\u009f€™]|â(?=[€\u0080-\u009f])|ï¿½|ï(?=¿)|¿(?=½)|(?<=¿)½")
_TERMINAL = ".!?:;…。！？"
#: Words before a word that are looked through for the same one.
WINDOW = 12

#: Sums over whole lines.
SUMS = ("chars", "words", "word_chars", "symbols", "lines", "ended", "common", "list", "table", "junk")
#: Features of one line; all add up, but for the flags that only its first piece or the last with text can tell.
_ADDED = ("n", "words", "word_chars", "symbols", "alnum", "space", "common", "garbled", "coded", "pairs", "fair", "again", "bars", "cells", "seps")
#: Characters of a line's beginning that its marks are looked for in.
BEGIN = 200


class Words:
    """What a corpus says of its words: which are common, and which pairs of letters are usual in them."""

    def __init__(self, common: Iterable[str] = (), pairs: Iterable[str] = ()) -> None:
        self.common, self.pairs = frozenset(common), frozenset(pairs)
        self.memo: dict[str, tuple[int, int]] = {}

    def __reduce__(self):
        return Words, (self.common, self.pairs)

    def fair(self, word: str) -> tuple[int, int]:
        """(letter pairs of a word, how many of them are usual)."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            pairs = letter_pairs(word.lower())
            got = self.memo[word] = (len(pairs), sum(map(self.pairs.__contains__, pairs)))
        return got


def letter_pairs(low: str) -> list[str]:
    return [low[i : i + 2] for i in range(len(low) - 1)] if low.isascii() and low.isalpha() and len(low) > 2 else []


def learn(df: DataFrame, text_col: str = "text", lang_col: str | None = None) -> Words:
    """Common words and usual letter pairs, from how many of all documents have each word.

    With ``lang_col`` a word is common when it is in one language; documents of no stated language count for the pairs
    only. What reaches the driver: at most 1 / ``COMMON_SHARE`` times the words a document has on average, a language; at
    most 676 pairs.
    """
    group = F.col(lang_col).cast("string") if lang_col else F.lit("")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str | None, Counter] = {}

        def given() -> pd.DataFrame:
            rows = [(g, w, n) for g, c in held.items() for w, n in c.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["group_", "word_", "n_"])

        for b in batches:
            for g, t in zip(b["group_"], b["text_"]):
                c = held.setdefault(g, Counter())
                c.update(set((_PLAIN_WORD if t.isascii() else _WORD).findall(t.lower())))
                # The empty word counts the documents.
                c[""] += 1
            if sum(map(len, held.values())) > 300_000:
                yield given()
        yield given()

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for w, n in zip(b["word_"], b["n_"]):
                for p in letter_pairs(w):
                    c[p] += n
        yield pd.DataFrame(list(c.items()), columns=["pair_", "n_"])

    with Scratch(df.sparkSession) as scratch:
        texts = df.where(F.col(text_col).isNotNull()).select(group.alias("group_"), F.col(text_col).alias("text_"))
        words = scratch.keep(texts.mapInPandas(count, "group_ string, word_ string, n_ bigint").groupBy("group_", "word_").agg(F.sum("n_").alias("n_")))
        sizes = words.where("word_ = '' AND group_ IS NOT NULL").select("group_", F.greatest(F.lit(LEAST_DOCUMENTS), F.col("n_") * COMMON_SHARE).alias("least_"))
        common = words.where("word_ <> ''").join(sizes, "group_").where("n_ >= least_").select("word_").distinct().toArrow()["word_"].to_pylist()
        several = words.where("word_ <> ''").groupBy("word_").agg(F.sum("n_").alias("n_")).where(F.col("n_") >= SEVERAL)
        counted = several.mapInPandas(pairs, "pair_ string, n_ bigint").groupBy("pair_").agg(F.sum("n_").alias("n_")).toArrow()
    total = sum(counted["n_"].to_pylist())
    return Words((w for w in common if not w.isdigit()), (p for p, n in zip(counted["pair_"].to_pylist(), counted["n_"].to_pylist()) if n >= total * USUAL_SHARE))


class Recent:
    """Where each word was last, in words from the beginning."""

    def __init__(self) -> None:
        self.at, self.last = 0, {}

    def add(self, words: list[str]) -> int:
        """How many of the next words are among the ``WINDOW`` before them."""
        at, last, again = self.at, self.last, 0
        for w in words:
            at += 1
            if last.get(w, -WINDOW) + WINDOW >= at:
                again += 1
            last[w] = at
        self.at = at
        return again


def line_features(line: str, lo: int, hi: int, recent: Recent, know: Words) -> dict:
    """Features of ``line[lo:hi]``, the rest of the line being context. What spans an edge counts where it begins."""
    whole = lo == 0 and hi == len(line)
    own = line if whole else line[lo:hi]
    f = dict.fromkeys(_ADDED, 0)
    if whole and own.isascii():
        words = _PLAIN_WORD.findall(own.lower())
        letters = sum(map(len, words))
    elif whole:
        words = _WORD.findall(own)
        letters = sum(map(len, words))
    else:
        words = [m.group() for m in _WORD.finditer(line) if lo <= m.start() < hi]
        letters = sum(map(len, _WORD.findall(own)))
    f["n"], f["words"] = len(own), len(words)
    f["word_chars"] = f["alnum"] = letters
    f["space"] = own.count(" ") + own.count("\t") + own.count("\r") + own.count("\xa0")
    f["symbols"] = len(own) - letters - f["space"]
    lows = words if whole and own.isascii() else [w.lower() for w in words]
    f["common"] = sum(map(know.common.__contains__, lows))
    f["again"] = recent.add(lows)
    if not whole or f["common"] * 10 <= len(words):
        for w in words:
            p, q = know.fair(w)
            f["pairs"] += p
            f["fair"] += q
        f["coded"] = sum(max(0, min(m.end(), hi) - max(m.start(), lo)) for m in _CODED.finditer(line) if _mixed(m.group()))
        inside = lambda pattern: sum(lo <= m.start() < hi for m in pattern.finditer(line))
        f["cells"] = inside(_COLUMNS)
        f["seps"] = max(own.count(",") - line.count(", ", lo, hi + 1), own.count(";") - line.count("; ", lo, hi + 1))
    if not own.isascii():
        f["garbled"] = sum(lo <= m.start() < hi for m in _GARBLED.finditer(line))
    f["bars"] = own.count("|")
    f["begin"] = own[:BEGIN]
    f["end"] = own.rstrip()[-1:]
    f["wide"] = "<" in own and any(lo <= m.start() < hi for m in _HTML_CELL.finditer(line))
    return f


def _mixed(token: str) -> bool:
    """Upper case, lower case and digits, as in text coded in base 64; paths and identifiers have no such mixture."""
    return sum((any(c.isupper() for c in token), any(c.islower() for c in token), any(c.isdigit() for c in token))) == 3 or "_" not in token and "-" not in token and "/" not in token and len(token) >= 60


def join_features(a: dict, b: dict) -> dict:
    f = {k: a[k] + b[k] for k in _ADDED}
    f["begin"] = (a["begin"] + b["begin"])[:BEGIN] if a["n"] < BEGIN else a["begin"]
    f["end"] = b["end"] or a["end"]
    f["wide"] = a["wide"] or b["wide"]
    return f


def line_class(f: dict) -> str:
    """``list``, ``table``, ``junk``, ``prose`` or, for blank lines, ``blank``."""
    seen = f["n"] - f["space"]
    if seen <= 0:
        return "blank"
    begin = f["begin"].strip()
    if f["wide"]:
        return "table"
    if f["bars"] >= 2 and begin.startswith("|") and (f["end"] == "|" and f["symbols"] <= 4 * f["bars"] + 0.4 * f["n"] or f["alnum"] > 0.5 * seen):
        return "table"
    if f["alnum"] < 0.5 * seen and not (f["words"] and f["common"] * 10 <= f["words"] and f["seps"] > 1 and f["symbols"] == f["seps"]):
        # Rules, leaders and noise of signs; a line of separators and few cells is a row.
        return "junk"
    bare = f["common"] * 10 <= f["words"]
    if f["garbled"] > 0.12 * seen or bare and f["coded"] > 0.5 * seen or _HEX.match(begin):
        return "junk"
    if f["words"] >= 1 and f["again"] >= 0.7 * f["words"]:
        return "junk"
    if bare:
        if f["symbols"] > 0.3 * seen and f["seps"] == 0 and f["bars"] == 0 and "/" not in begin and not _MARKED.match(begin):
            return "junk"
        if f["pairs"] >= 8 and f["fair"] < 0.5 * f["pairs"]:
            return "junk"
        if f["seps"] >= 2 and f["words"] <= 6 * (f["seps"] + 1):
            return "table"
        if f["cells"] >= 2 or "\t" in begin or f["bars"] >= 2:
            return "table"
    if begin.startswith("#"):
        return "prose"
    if _MARKED.match(f["begin"]) and f["words"] <= 30:
        return "list"
    if f["common"] * 6 <= f["words"] and f["words"] <= 16 and f["end"] not in ".!?":
        if _PATH.match(begin) or _NAMED.match(begin):
            return "list"
        if f["words"] <= 6 and f["n"] <= 60:
            return "list"
    return "prose"


def _add_line(sums: dict, f: dict) -> None:
    kind = line_class(f)
    if kind == "blank":
        return
    sums["lines"] += 1
    sums["ended"] += f["end"] in _TERMINAL
    if kind in ("list", "table", "junk"):
        sums[kind] += f["n"]


def partial(piece: str, lo: int, hi: int, know: Words) -> dict:
    """Counts of ``piece[lo:hi]``; what lies outside is context. head and tail are the lines cut by its ends, the same
    one where no line ends within."""
    sums = dict.fromkeys(SUMS, 0)
    recent = Recent()
    if lo:
        recent.add([m.group().lower() for m in _WORD.finditer(piece[: lo + CONTEXT]) if m.start() < lo])
    at, head, tail = lo, None, None
    while True:
        stop = piece.find("\n", at, hi)
        last = stop < 0
        end = hi if last else stop
        if at == lo and lo or last and hi < len(piece):
            # The word at either edge is completed, or left to the chunk where it begins.
            a = max(piece.rfind("\n", 0, at) + 1, 0) if at == lo else at
            b = piece.find("\n", end)
            b = len(piece) if b < 0 else b
            f = line_features(piece[a:b], at - a, end - a, recent, know)
        else:
            f = line_features(piece[at:end], 0, end - at, recent, know)
        for k, g in (("words", "words"), ("word_chars", "word_chars"), ("symbols", "symbols"), ("common", "common"), ("chars", "n")):
            sums[k] += f[g]
        if at == lo:
            head = f
        elif not last:
            _add_line(sums, f)
        if last:
            tail = None if at == lo else f
            break
        at = stop + 1
    return {"sums": sums, "head": head, "tail": tail}


def merge(a: dict, b: dict) -> dict:
    sums = {k: a["sums"][k] + b["sums"][k] for k in SUMS}
    if a["tail"] is None:
        joined = join_features(a["head"], b["head"])
        return {"sums": sums, "head": joined, "tail": b["tail"]}
    joined = join_features(a["tail"], b["head"])
    if b["tail"] is None:
        return {"sums": sums, "head": a["head"], "tail": joined}
    _add_line(sums, joined)
    return {"sums": sums, "head": a["head"], "tail": b["tail"]}


def finished(p: dict) -> tuple:
    sums = dict(p["sums"])
    for f in (p["head"], p["tail"]):
        if f is not None:
            _add_line(sums, f)
    return tuple(sums[k] for k in SUMS)


_OUT = ", ".join(f"{k}_ bigint" for k in SUMS)


def text_sums(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, lang_col: str | None = None, words: Words | None = None) -> DataFrame:
    """(id, sums): the exact counts of every document with text that is not null, however long. ``chunk`` changes no
    result, only what a task holds. words: learned from the documents where it isn't given."""
    shared = df.sparkSession.sparkContext.broadcast(words or learn(df, text_col, lang_col))
    kind = df.schema[id_col].dataType.simpleString()
    context = min(CONTEXT, chunk)
    size = F.length("text_")
    n = F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int")
    split = df.where(F.col(text_col).isNotNull()).select(keyed(id_col), F.col(text_col).alias("text_"))
    split = split.select("id_", "text_", n.alias("n_"))
    small = split.where(F.col("n_") == 1)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        know = shared.value
        for b in batches:
            rows = [(k, *finished(partial(t, 0, len(t), know))) for k, t in zip(b["id_"], b["text_"])]
            yield pd.DataFrame(rows, columns=["id_", *(f"{k}_" for k in SUMS)])

    out = small.select("id_", "text_").mapInPandas(whole, f"id_ string, {_OUT}")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        know = shared.value
        for b in batches:
            rows = []
            for k, h, c, t in zip(b["id_"], b["hash_"], b["chunk_"], b["piece_"]):
                lo = min(context, c * chunk)
                rows.append((k, h, c, json.dumps(partial(t, lo, min(len(t), lo + chunk), know))))
            yield pd.DataFrame(rows, columns=["id_", "hash_", "chunk_", "state_"])

    large = split.where(F.col("n_") > 1).select("id_", F.xxhash64("text_").alias("hash_"), "text_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("chunk_"))
    start = F.greatest(F.lit(0), F.col("chunk_") * chunk - context)
    states = large.select("id_", "hash_", "chunk_", F.substring("text_", start + 1, F.col("chunk_") * chunk - start + chunk + context).alias("piece_"))
    # A text repeated under one id gives each chunk twice; either is kept.
    states = states.mapInPandas(pieces, f"id_ string, hash_ bigint, chunk_ int, state_ string").dropDuplicates(["id_", "hash_", "chunk_"])

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk_")
        state = json.loads(g["state_"].iloc[0])
        for s in g["state_"].iloc[1:]:
            state = merge(state, json.loads(s))
        return pd.DataFrame([(g["id_"].iloc[0], g["hash_"].iloc[0], g["chunk_"].iloc[0] // FAN, json.dumps(state))], columns=["id_", "hash_", "chunk_", "state_"])

    for _ in range(LEVELS):
        states = states.withColumn("group_", F.expr(f"chunk_ div {FAN}")).groupBy("id_", "hash_", "group_").applyInPandas(merged, f"id_ string, hash_ bigint, chunk_ int, state_ string")

    def closing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *finished(json.loads(s))) for k, s in zip(b["id_"], b["state_"])], columns=["id_", *(f"{k}_" for k in SUMS)])

    out = out.unionByName(states.select("id_", "state_").mapInPandas(closing, f"id_ string, {_OUT}"))
    return restored(out, id_col, kind)


def text_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, lang_col: str | None = None, words: Words | None = None) -> DataFrame:
    """(id, char_count, word_count, mean_word_length, symbol_ratio, punctuated_line_share, common_word_share,
    list_share, table_share, junk_share, kind).

    Words are runs of letters and digits, common ones those of ``learn``; symbols all other characters but blanks and line ends; shares of lines are of
    lines with text. kind: ``list``, ``table`` or ``junk`` where lines of that class hold more than half of the
    characters, else ``prose``. Null text gives no row; blank text a row of zeros and null ratios and kind.
    """
    c = {k: F.col(f"{k}_") for k in SUMS}
    safe = lambda a, b: F.when(b > 0, a / b)
    out = text_sums(df, id_col, text_col, chunk, lang_col, words)
    kind = F.when(c["lines"] == 0, F.lit(None).cast("string"))
    for k in ("table", "list", "junk"):
        kind = kind.when(c[k] * 2 > c["chars"], k)
    return out.select(
        id_col,
        c["chars"].alias("char_count"),
        c["words"].alias("word_count"),
        safe(c["word_chars"], c["words"]).alias("mean_word_length"),
        safe(c["symbols"], c["chars"]).alias("symbol_ratio"),
        safe(c["ended"], c["lines"]).alias("punctuated_line_share"),
        safe(c["common"], c["words"]).alias("common_word_share"),
        *(safe(c[k], c["chars"]).alias(f"{k}_share") for k in ("list", "table", "junk")),
        kind.otherwise("prose").alias("kind"),
    )


def not_prose(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, words: Words | None = None) -> DataFrame:
    """(id, kind) of the documents that are lists, tables or junk."""
    return text_quality(df, id_col, text_col, lang_col=lang_col, words=words).where(F.col("kind").isin("list", "table", "junk")).select(id_col, "kind").distinct()
