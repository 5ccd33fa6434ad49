"""Noise in text from scanned pages: damaged lines, and the text repaired.

1. The words of all texts are counted (fragments at line breaks left out). Words above a share of all, so a number
   bounded by that share, are the lexicon.
2. Skip-gram vectors of the lexicon are trained on the pair counts of all texts. A rare word has the sum of the context
   vectors where it stands; it is linked with those frequent words near it in the vector space that a plausible
   misreading turns into it. (The two conditions are tested in the cheaper order, the edit first.)
3. Lines at the edges of pages are compared over the pages of their source by their shapes, with aggregates over
   (source, shape) only, so that a source of any size is spread: they give headers, footers and page labels.
4. Every record is then read on its own: rare words are linked with frequent ones by plausible misreadings, broken and
   parted words are joined, and the vectors decide between candidates in context.
5. Repair replaces, joins, drops furniture and reflows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine.session import Scratch
from millrace.llm.glyphs import NEGATIVES, Lexicon, folded, train_vectors

#: A word of the lexicon makes up at least this share of all words; so the lexicon has at most 5,000.
SHARE = 2e-4
LEAST = 3
#: A rare word of at least this share of all words has a vector of its own, from all its contexts; so at most a million.
#: A rarer one is linked by its shape alone.
RARE_SHARE = 1e-6
#: Words that are contexts, the most frequent first; and the window of a pair.
VECTOR_WORDS = 2_048
WINDOW = 2
#: A rare word's contexts tell against a reading when their log-odds are less than UNLIKE on average, and than -DOUBT in all.
UNLIKE, DOUBT = -1.0, 10.0
#: Lines at either edge of a page that may be furniture, and how many characters and words they have at most (a page
#: number may be set apart by a few blanks).
EDGE, EDGE_CHARS, EDGE_WORDS = 2, 72, 9

BREAKS = "-‐‑=¬\xad"
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_BROKEN = re.compile(rf"([^\W_][\w\-]*)([{BREAKS}])[ \t\r]*$")
_MARKER = re.compile(r"<!-- (?:page|sheet) (\d+) -->\s*$")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_LIST = re.compile(r"\s*(?:#{1,6}\s|[-*+•]\s|\||>|```)")

# --------------------------------------------------------------------------------------------- lines of a record


@dataclass(slots=True)
class Line:
    no: int
    text: str
    page: int | None
    kind: str = "text"  # text, blank, marker, fence, code


def lines_of(text: str, page: int | None) -> list[Line]:
    out, fenced = [], False
    for i, t in enumerate(text.split("\n"), 1):
        m = _MARKER.match(t) if t[:4] == "<!--" else None
        if m:
            page, fenced = int(m[1]), False
            out.append(Line(i, t, page, "marker"))
        elif ("`" in t or "~" in t) and _FENCE.match(t):
            fenced = not fenced
            out.append(Line(i, t, page, "fence"))
        else:
            out.append(Line(i, t, page, "code" if fenced else "blank" if not t.strip() else "text"))
    return out


_ANY_BREAK = re.compile(rf"[{BREAKS}][ \t\r]*(?:\n|$)")
_CUT_WORD = re.compile(rf"[{BREAKS}][ \t\r]*\n\s*(\S+)")


def count_tokens(texts: list[str], into: Counter) -> None:
    """Adds the blank-separated tokens of the texts, without the pieces of words broken at line ends."""
    for t in texts:
        into.update(t.split())
        for m in _CUT_WORD.finditer(t, 1):
            if not t[m.start() - 1].isalnum():
                continue
            into[t[: m.start() + 1][-200:].split()[-1]] -= 1
            into[m[1]] -= 1


def token_words(token: str) -> list[str]:
    """The lower-cased words in a token; compounds are one word."""
    return _TOKEN.findall(token.lower())


# --------------------------------------------------------------------------------------------- furniture

_DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "g": "9", "q": "9", "Z": "2", "z": "2"})
_NUM = r"[0-9lIO|oSsBgqZz]{1,6}"
_ROMAN = r"[ivxlcdm1]{1,9}"
_LABELS = tuple(
    (name, re.compile(p, re.I if "page" in name else 0))
    for name, p in (
        ("page of", rf"[^\w\s]?\s*\w?a[g9q][ec€]\s+({_NUM})\s+[o0]f\s+({_NUM})"),
        ("page", rf"[^\w\s]?\s*\w?a[g9q][ec€]\s+({_NUM}|{_ROMAN})"),
        ("p", rf"[pP]\.?\s*({_NUM})"),
        ("of", rf"({_NUM})\s+of\s+({_NUM})"),
        ("slash", rf"({_NUM})\s*/\s*({_NUM})"),
        ("bracket", rf"[\[(]\s*({_NUM})\s*[\])]"),
        ("dash", rf"[—–\-~]\s*({_NUM})\s*[—–\-~]"),
        ("bare", rf"({_NUM})"),
        ("roman", rf"({_ROMAN})"),
    )
)
_ROMAN_VALUE = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000, "1": 1}


def label_of(text: str) -> tuple[str, int] | None:
    """(form, number) of a line that is only a page label."""
    t = text.strip()
    if not 0 < len(t) <= 24:
        return None
    for name, p in _LABELS:
        m = p.fullmatch(t)
        if not m:
            continue
        raw = m[1]
        if name == "roman" or name == "page" and not any(c.isdigit() for c in raw) and re.fullmatch(_ROMAN, raw):
            low = raw.lower()
            v = [_ROMAN_VALUE[c] for c in low]
            n = sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))
            if name == "page" or n > 0:
                return name if name == "roman" else "page", n
            continue
        number = raw.translate(_DIGITS)
        if number.isdigit() and (any(c.isdigit() for c in raw) or name in ("page", "page of", "p", "slash", "bracket", "dash") or re.fullmatch("[lIO|]{1,3}", raw)):
            return name, int(number)
    return None


_NO_LETTER = re.compile(r"[\d\W_]+")


def letters_of(text: str) -> str:
    return folded(_NO_LETTER.sub("", text))


def shape_keys(text: str) -> list[str]:
    """Two of three thirds of a line's letters, three ways: one misreading leaves one of them."""
    s = letters_of(text)
    if len(s) < 6:
        return []
    a, b = len(s) // 3, 2 * len(s) // 3
    x, y, z = s[:a], s[a:b], s[b:]
    return [f"1{x}{y}", f"2{y}{z}", f"3{x}.{z}"]


_NUMBERED = re.compile(r"\S+.*\s{2,}\d{1,6}$|^\d{1,6}\s{2,}\S+")


def looks_running(text: str) -> bool:
    """Whether an edge line is worded like a header: a title, all capitals, or set apart from a page number."""
    t = text.strip()
    if _LIST.match(t) or t[-1:] in ".:;,!?" or len(t) > EDGE_CHARS:
        return False
    words = re.findall(r"[^\W\d_]{2,}", t)
    if not words or len(words) > 8:
        return False
    if _NUMBERED.match(t) and not t[0].islower():
        return True
    words = [w for w in re.sub(r"\W*\|.*$|\s{2,}\d+$", "", t).split() if any(c.isalpha() for c in w)]
    big = [w for w in words if w.lower() not in ("of", "the", "and", "for", "in", "on", "to")]
    low = [w for w in big if not w[0].isupper()]
    # One word may have been parted by a blank.
    return 2 <= len(words) <= 7 and len(big) - len(low) >= 2 and (not low or len(low) == 1 and len(low[0]) <= 5 and big[0] != low[0] and len(big) >= 4)


_MARKERS = re.compile(r"^<!-- (?:page|sheet) (\d+) -->[ \t\r]*$", re.M)
_SENTENCE = re.compile(r"[a-z,;][.!?:]? [a-z].*[a-z][.!?] |[a-z][.!?] [A-Z]")


def _sections(text: str, page: int | None) -> Iterator[tuple[int | None, int, list[str]]]:
    """(page, number of the first line, lines) of each page in a text."""
    at, no = 0, 1
    for m in _MARKERS.finditer(text):
        part = text[at : m.start()]
        yield page, no, part.split("\n")[:-1]
        no += part.count("\n") + 1
        page, at = int(m[1]), m.end() + 1
    yield page, no, text[at:].split("\n")


def edges_of(text: str, page: int | None) -> list[tuple]:
    """(line_no, page, top, rank, text, label form, number, guarded) of the lines at the edges of each page.

    A label is guarded when the text next to it continues through it: numbers in a row, or after a colon.
    """
    out = []
    for p, start, lines in _sections(text, page):
        if any(x.startswith(("```", "~~~")) for x in lines):
            kept = [x.no for x in lines_of("\n".join(lines), p) if x.kind == "text"]
        else:
            n, kept, tail = len(lines), [], []
            i = 0
            while i < n and len(kept) <= EDGE:
                if lines[i].strip():
                    kept.append(i + 1)
                i += 1
            j = n - 1
            while j >= i and len(tail) <= EDGE:
                if lines[j].strip():
                    tail.append(j + 1)
                j -= 1
            kept += reversed(tail)
        n = len(kept)
        for top in (True, False):
            for rank in range(min(EDGE, n)):
                at = rank if top else n - 1 - rank
                if n <= EDGE and not top and at < EDGE:
                    continue
                t = lines[kept[at] - 1].strip()
                if len(t) > EDGE_CHARS or t.count(" ") >= EDGE_WORDS + 4:
                    continue
                label = label_of(t)
                if label is None and (_LIST.match(t) or _SENTENCE.search(t)):
                    continue
                next_in = at + 1 if top else at - 1
                guarded = False
                if label and 0 <= next_in < n and abs(kept[next_in] - kept[at]) == 1:
                    near = lines[kept[next_in] - 1].strip()
                    guarded = bool(re.fullmatch(rf"[\W\d_]*|{_NUM}\s+of\s+{_NUM}", near)) or (near.endswith(":") if not top else near[:1].islower() and label[0] in ("bare", "of", "dash"))
                out.append((start + kept[at] - 1, p, top, rank, t, label[0] if label else None, label[1] if label else None, guarded))
    return out


# --------------------------------------------------------------------------------------------- damage of a record

_MARKS = ".,;:()!?\"'`*#—–[]{}<>“”‘’…"
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{16,}|[A-Za-z0-9+/=]{40,}")
_PARTS = re.compile(r"[_/\\.,;:()\[\]{}<>\"'`&+=*#%@!?]+")


class Reader:
    """Finds and corrects the damage of one record at a time."""

    def __init__(self, counts: dict[str, int], index: dict[str, int], words: np.ndarray, contexts: np.ndarray, known: dict[str, tuple[str, ...]] | None = None) -> None:
        self.lexicon = Lexicon(counts, known)
        self.index, self.vectors, self.contexts = index, words, contexts
        self.judged: dict[str, tuple[bool, str]] = {}
        #: Tokens as they stand, marks included, that need no second look.
        self.fine: set[str] = set()
        words = self.lexicon.words
        self.firsts = {w[:i] for w in words for i in range(2, len(w) - 1) if "-" not in w and w[:i] in words and w[i:] in words}

    def quiet(self, tokens: list[str]) -> bool:
        """Whether none of a line's tokens can be damaged."""
        if not self.fine.issuperset(tokens):
            if len(self.fine) > 500_000:
                self.fine.clear()
            for t in tokens:
                if t not in self.fine:
                    core = t.strip(_MARKS).lower()
                    good, kind = self.word(core)
                    if not good or kind == "single":
                        return False
                    self.fine.add(t)
        return self.firsts.isdisjoint(tokens)

    def clean(self, text: str) -> bool:
        """Whether a whole text is without any token that could be damaged and any broken line."""
        tokens = set(text.split())
        if not self.fine.issuperset(tokens):
            for t in tokens - self.fine:
                core = t.strip(_MARKS).lower()
                good, kind = self.word(core)
                if not good or kind == "single":
                    return False
                self.fine.add(t)
        return self.firsts.isdisjoint(tokens) and not _ANY_BREAK.search(text)

    def likely(self, candidate: str, around: list[str]) -> float:
        """How well a word fits between its neighbours: the mean predicted log-odds, from the vectors."""
        i = self.index.get(candidate)
        near = [j for w in around if (j := self.index.get(w, -1)) >= 0 and j < len(self.contexts)]
        if i is None or not near:
            return 0.0
        return float((self.contexts[near] @ self.vectors[i]).mean())

    def best(self, candidates: tuple[str, ...], around: list[str]) -> str:
        if len(candidates) == 1:
            return candidates[0]
        return max(candidates, key=lambda w: (self.likely(w, around) + 0.25 * np.log(self.lexicon.counts[w]), w))

    def word(self, core: str) -> tuple[bool, str]:
        """(fine, kind) of a bare lower-cased token; kind ``unknown`` when nothing frequent is like it."""
        got = self.judged.get(core)
        if got is None:
            if len(self.judged) > 500_000:
                self.judged.clear()
            got = self.judged[core] = self._word(core)
        return got

    def _word(self, core: str) -> tuple[bool, str]:
        lex = self.lexicon
        if not core or core in lex.words or not any(c.isalnum() for c in core) and not any(c in "€†■�" for c in core):
            return True, ""
        if all(c.isdigit() for c in core) or _HEX.fullmatch(core):
            return True, ""
        if "_" in core or "/" in core:
            parts = [p for p in re.split(r"[_/.\\]+", core) if p]
            return (True, "") if all(self.word(p)[0] for p in parts) else (False, "parts")
        if lex.links(core):
            return False, "linked"
        if core in lex.known and core.isalpha():
            # It looks like a frequent word, but stands where that one doesn't.
            return True, ""
        if "-" in core:
            parts = [p for p in core.split("-") if p]
            if len(parts) > 1 and all(p in lex.parts or p in lex.words or p.isdigit() for p in parts) and not core.startswith("-") and not core.endswith("-"):
                return True, ""
            return False, "parts" if any(self.word(p)[1] in ("linked", "joined", "garbled") for p in parts) else "unknown"
        parts = [p for p in _PARTS.split(core) if p]
        if len(parts) > 1:
            if all(self.word(p)[0] for p in parts):
                return (False, "joined") if all(any(c.isalpha() for c in p) for p in parts) else (True, "")
            return False, "parts" if any(self.word(p)[1] in ("linked", "joined", "garbled") for p in parts) else "unknown"
        for i in range(1, len(core)):
            if (core[:i] in lex.words and (i > 1 or core[0] == "a")) and core[i:] in lex.words and len(core) - i > 1:
                return False, "joined"
            if core[:i] in lex.words and lex.links(core[i:]) and i > 2 and len(core) - i > 3 or core[i:] in lex.words and lex.links(core[:i]) and i > 3 and len(core) - i > 2:
                return False, "joined"
        if any(not c.isascii() and not c.isalpha() or c in "~^|" for c in core):
            return False, "garbled"
        if len(core) == 1:
            return True, "single"
        return False, "unknown"

    def joins(self, a: str, b: str) -> str | None:
        """The frequent word that two tokens make when put together."""
        w = a + b
        if w in self.lexicon.words:
            return w
        found = self.lexicon.links(w) if len(w) >= 5 else ()
        return found[0] if found else None

    def broken(self, left: str, mark: str, right: str | None, around: list[str], beyond: list[str]) -> tuple[bool | None, str | None]:
        """(whether the line ends inside a word, the whole word if known) of ``left`` + mark at a line's end; None when
        a compound may have been parted as well and its rest isn't here."""
        lex = self.lexicon
        if mark != "-":
            return True, self.joins(left, right) if right else None
        tail = right if right else ""
        compound = f"{left}-{tail}" in lex.words if tail else False
        if not compound and tail:
            # A compound of three parts may be parted twice, and its rest may hold the sentence's own marks.
            compound = any(w.startswith(f"{left}-{tail}-") for w in lex.words) if f"{left}-{tail}" in lex.starts else False
        whole = left + tail if tail and left + tail in lex.words else None
        if compound and whole:
            one, two = (self.likely(w, around[-1:]) + self.likely(w, beyond[:1]) for w in (whole, f"{left}-{tail}"))
            return (True, whole) if one > two else (False, None)
        if compound:
            return False, None
        if whole:
            return True, whole
        last = left.rsplit("-", 1)[-1]
        if tail:
            near, word = lex.links(f"{left}-{tail}"), lex.links(left + tail)
            if near and any("-" in w for w in near) and not any("-" not in w for w in word):
                return False, None
            if word:
                return True, word[0]
        heads, openings = lex.heads.get(left, 0), lex.openings.get(left, 0)
        if heads and heads * 3 >= openings:
            return False, None
        if heads and not tail:
            return None, None
        if "-" in left and last not in lex.starts:
            return True, None
        return True, None

    def damage(self, lines: list[Line], furniture: frozenset[int] | None = None, finished: bool = True) -> list[tuple[int, str, int, int, str]]:
        """(line_no, damage, start, end, correction): what is wrong in each line, and what the characters between start
        and end were printed as, "" when that can't be told. furniture: numbers of lines to pass over; None, when they
        aren't known, passes over what looks like it at page edges. finished: whether the record's last line is whole."""
        out: list[tuple[int, str, int, int, str]] = []
        text: list[tuple[Line, bool]] = []
        held: list[Line] = []
        page: list[Line] = []
        for x in [*lines, None]:
            if x is not None and x.kind == "text":
                page.append(x)
            if x is not None and x.kind != "marker":
                continue
            if furniture is not None:
                page = [y for y in page if y.no not in furniture]
            else:
                # What looks like furniture is read for its own damage, but not as a part of the text around it.
                edge = {*range(min(EDGE, len(page))), *range(max(0, len(page) - EDGE), len(page))}
                off = {i for i in edge if len(page[i].text) <= EDGE_CHARS and (label_of(page[i].text) is not None or looks_running(page[i].text))}
                held += [page[i] for i in sorted(off)]
                page = [y for i, y in enumerate(page) if i not in off] if off else page
            text += [(y, i == 0) for i, y in enumerate(page)]
            page = []
        after = False
        for k, (line, at_top) in enumerate(text):
            nxt = text[k + 1][0] if k + 1 < len(text) else None
            after = self._line(line, nxt, after, at_top, not finished and nxt is None, out)
        if furniture is None:
            for x in held:
                self._line(x, None, False, False, False, out)
        return out

    def _line(self, line: Line, nxt: Line | None, after: bool, at_top: bool, cut_off: bool, out: list) -> bool:
        """Adds the damage of one line; tells whether it ends in a broken word. after: whether the line before did."""
        raw = line.text
        tokens = raw.split()
        m = _BROKEN.search(raw) if raw.rstrip()[-1:] in BREAKS else None
        if m is None and not cut_off and (self.quiet(tokens) or after and self.quiet(tokens[1:])):
            return False
        lex = self.lexicon
        cores, at = [], 0
        for t in tokens:
            at = raw.index(t, at)
            o = t.strip(_MARKS)
            start = at + t.find(o) if o else at
            cores.append((start, start + len(o), o.lower()))
            at += len(t)
        last = len(cores) - 1
        first = 1 if cores and last > 0 and cores[0][2] in ("-", "*", "+", "•", "") else 0
        skip = after
        if at_top and not after and first <= last:
            # The rest of a word that began on the page before.
            c = cores[first][2]
            skip = raw[cores[first][0] : cores[first][0] + 1].islower() and c not in lex.words and c in lex.ends
        if m:
            left = m[1].lower().lstrip("-")
            right, r = None, None
            if nxt is not None:
                r = re.match(r"\s*([^\W_]+)", nxt.text)
                right = r[1].lower() if r and not r[1][0].isupper() else None
            beyond = [t.strip(_MARKS).lower() for t in nxt.text.split()[1:2]] if nxt is not None else []
            beyond = [w if w in lex.words else (*lex.links(w), w)[0] for w in beyond]
            ends_in, whole = self.broken(left, m[2], right, [c for _, _, c in cores[-3:-1]], beyond)
            if ends_in is None:
                # The end of a record: broken where the record has other damage.
                ends_in = bool(out)
            if ends_in and not cut_off:
                out.append((line.no, "hyphen", m.start(1), len(raw), whole or ""))
            fragment = self._fragment(left, right, ends_in, whole)
            if fragment == "left" and not cut_off:
                out.append((line.no, "misread", m.start(1), m.start(2), ""))
            elif fragment == "right" and r is not None:
                out.append((nxt.no, "misread", r.start(1), r.end(1), ""))
        # The last word of a text that was cut is whole only before a mark that ends something.
        torn = cut_off and not m and raw.rstrip()[-1:] not in ".!?:;,)"
        lo, hi = first + skip, last - bool(m) - torn
        i = lo
        while i <= hi:
            a, b, core = cores[i]
            fine, kind = self.word(core)
            if fine and kind != "single":
                i += 1
                continue
            beside = [cores[j][2] for j in range(max(0, i - 2), min(len(cores), i + 3)) if j != i]
            pairs = [(i, i + 1)] if i < hi else []
            pairs += [(i - 1, i)] if i > lo else []
            whole = None
            for exact in (True, False):
                if not exact and (kind in ("linked", "single", "joined")):
                    break
                for x, y in pairs:
                    two = cores[x][2], cores[y][2]
                    w = two[0] + two[1] if exact and two[0] + two[1] in lex.words else None if exact else self.joins(*two)
                    if w and cores[x][1] + 1 == cores[y][0] and not (kind == "single" and self.word(two[0])[0] and self.word(two[1])[0] and two[0] in ("a", "n")):
                        whole = (x, y, w)
                        break
                if whole:
                    break
            if whole:
                x, y, w = whole
                out.append((line.no, "misread", cores[x][0], cores[y][1], w))
                i = y + 1
                continue
            if not fine and (kind != "unknown" or self.unknown_counts(core)):
                fix = self.best(lex.links(core), beside) if kind == "linked" else self.parts_of(core) if kind == "joined" else ""
                out.append((line.no, "misread", a, b, fix))
            i += 1
        # Pairs of which either part is a word by itself.
        for i in range(lo, hi):
            a, b, core = cores[i]
            c, d, other = cores[i + 1]
            if core in self.firsts and b + 1 == c and core + other in lex.words and other in lex.words and self.parted(core, other):
                out.append((line.no, "misread", a, d, core + other))
        return m is not None

    def parts_of(self, core: str) -> str:
        """Two frequent words that were run together, parted again."""
        words = self.lexicon.words
        cuts = [i for i in range(1, len(core)) if core[:i] in words and core[i:] in words]
        return " ".join(max(((core[:i], core[i:]) for i in cuts), key=lambda p: (self.likely(p[0], [p[1]]), len(p[0])))) if cuts else ""

    def parted(self, a: str, b: str) -> bool:
        """Whether two frequent words in a row are rather one word with a blank in it."""
        i, j = self.index.get(a), self.index.get(b)
        if i is None or j is None or j >= len(self.contexts):
            return True
        return float(self.vectors[i] @ self.contexts[j]) < 0

    def unknown_counts(self, core: str) -> bool:
        """Unlinked rare words are damage when digits or signs are mixed into their letters, or when most of their shape
        begins or ends frequent words: two misreadings in one."""
        if re.search(r"[a-z]\d[a-z]|\d[a-z]{2,}|[a-z]{2,}\d", core) :
            return True
        shape = folded(core)
        near = sum(shape[:n] in self._shape_starts for n in range(3, len(shape) + 1))
        back = sum(shape[-n:] in self._shape_ends for n in range(3, len(shape) + 1))
        return len(core) > 5 and near + back >= len(shape) - 3

    @property
    def _shape_starts(self) -> set[str]:
        if not hasattr(self, "_ss"):
            self._ss = {folded(w)[:i] for w in self.lexicon.words for i in range(3, len(w) + 1)}
        return self._ss

    @property
    def _shape_ends(self) -> set[str]:
        if not hasattr(self, "_se"):
            self._se = {folded(w)[-i:] for w in self.lexicon.words for i in range(3, len(w) + 1)}
        return self._se

    def repair(self, lines: list[Line], furniture: frozenset[int] = frozenset(), finished: bool = True) -> tuple[str, str | None]:
        """(the text corrected, without furniture and markers, in paragraphs of one line each; the beginning of the word
        that is broken at its end). Code, lists, headings and rows of tables keep their lines; a paragraph goes on over a
        page end where its sentence does."""
        wrong: dict[int, list[tuple[str, int, int, str]]] = {}
        for no, kind, a, b, fix in self.damage(lines, furniture, finished):
            wrong.setdefault(no, []).append((kind, a, b, fix))
        blocks: list[str] = []
        open_, glue, pending, turned, part = False, " ", "", False, None
        for line in lines:
            if line.kind in ("fence", "code"):
                blocks, open_ = self._put(blocks, line.text, line.kind == "code" and bool(blocks)), False
                continue
            if line.kind == "marker" or line.no in furniture:
                turned = True
                continue
            if line.kind == "blank":
                open_ = open_ and turned
                continue
            text, whole, broken = line.text, "", False
            for kind, a, b, fix in sorted(wrong.get(line.no, ()), key=lambda x: -x[1]):
                if kind == "hyphen":
                    whole, broken = fix, True
                    text = text[:a] + text[a:b].rstrip().rstrip(BREAKS)
                elif fix and b <= len(text):
                    was = text[a:b]
                    text = text[:a] + (fix.capitalize() if was[:1].isupper() and not was.isupper() else fix.upper() if was.isupper() and len(was) > 1 else fix) + text[b:]
            text = text.rstrip()
            if pending:
                # The word that the line before began is known whole.
                head, _, rest = text.lstrip().partition(" ")
                marks = head[len(head.rstrip(".,;:!?)")) :]
                blocks[-1] = blocks[-1][: blocks[-1].rfind(" ") + 1] + pending + marks
                text, glue = rest, " "
            starts = bool(_LIST.match(text))
            goes_on = open_ and not starts and (not turned or blocks and blocks[-1][-1:] not in ".!?:" or glue == "")
            if goes_on and blocks:
                blocks[-1] += (glue if text else "") + text.lstrip()
            elif text:
                blocks.append(text.strip() if not starts else text)
            m = _BROKEN.search(line.text)
            pending, glue, open_, turned = whole if broken and self.follows(lines, line) else "", "" if m else " ", True, False
            part = text.split()[-1] if broken and not self.follows(lines, line) and text.split() else None
        return "\n\n".join(b for b in blocks if b), part

    @staticmethod
    def follows(lines: list[Line], line: Line) -> bool:
        return any(x.kind == "text" for x in lines[line.no :])

    @staticmethod
    def _put(blocks: list[str], text: str, go_on: bool) -> list[str]:
        return [*blocks[:-1], f"{blocks[-1]}\n{text}"] if go_on else [*blocks, text]

    def _fragment(self, left: str, right: str | None, ends_in: bool, whole: str | None) -> str | None:
        """Which piece of a word parted at a line's end is misread: ``left``, ``right`` or neither."""
        lex = self.lexicon
        if not ends_in:
            pieces = left.split("-")
            if all(p in lex.parts or p in lex.words for p in pieces):
                return "right" if right and right not in lex.parts and right not in lex.words and not right.isdigit() else None
            return "left"
        if right and left + right in lex.words:
            return None
        if left not in lex.starts and not (left.split("-")[-1] in lex.starts and "-" in left):
            return "left"
        if right and right not in lex.ends and not self.word(right)[0]:
            return "right"
        if whole and right and left + right != whole:
            return "left" if not whole.startswith(left) else "right" if not whole.endswith(right) else None
        return None


# --------------------------------------------------------------------------------------------- tables


@dataclass(frozen=True)
class Part:
    """Texts of one kind of record. page: the column with the page a text is, None where it has page markers or none.
    finished: a column that tells whether a text's last line is whole, None where all are. paged: whether the texts are
    of whole pages, with headers, footers and labels."""

    df: DataFrame
    record_type: str
    record_id: str
    text: str
    source: str = "source"
    page: str | None = None
    finished: str | None = None
    paged: bool = True


def records(parts: list[Part]) -> DataFrame:
    """(record_type, record_id, source, page, text, finished) of the records with text."""
    out = None
    for p in parts:
        one = p.df.where(F.col(p.text).isNotNull()).select(
            F.lit(p.record_type).alias("record_type"),
            F.col(p.record_id).cast("long").alias("record_id"),
            F.coalesce(F.col(p.source).cast("string"), F.lit("")).alias("source"),
            (F.col(p.page).cast("int") if p.page else F.lit(None).cast("int")).alias("page"),
            F.col(p.text).cast("string").alias("text"),
            (F.coalesce(F.col(p.finished), F.lit(False)) if p.finished else F.lit(True)).alias("finished"),
            F.lit(p.paged).alias("paged"),
        )
        out = one if out is None else out.unionByName(one)
    return out


_CENSUS = (
    "word string, n bigint, record_type string, record_id bigint, source string, line_no bigint, page int, top boolean, rank int, "
    "form string, number bigint, guarded boolean, titled boolean, keys array<string>"
)


def _census(df: DataFrame) -> DataFrame:
    """One pass over all texts: partial counts of words (``word`` set), and lines at page edges (``word`` null)."""
    names = [c.split()[0] for c in _CENSUS.split(", ")]

    def flush(raw: Counter) -> pd.DataFrame:
        total: Counter = Counter()
        for token, n in raw.items():
            if n > 0:
                for w in token_words(token):
                    total[w] += n
        none = [None] * len(total)
        return pd.DataFrame({c: list(total) if c == "word" else list(total.values()) if c == "n" else none for c in names}, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: Counter = Counter()
        for b in batches:
            count_tokens(list(b["text"]), raw)
            rows = []
            for kind, key, source, page, text, paged in zip(b["record_type"], b["record_id"], b["source"], b["page"], b["text"], b["paged"]):
                if not paged:
                    continue
                for no, p, top, rank, t, form, number, guarded in edges_of(text, None if pd.isna(page) else int(page)):
                    keys = [] if form else [*shape_keys(t), *rims(t)]
                    if form or keys and t[-1] not in ".,;:":
                        rows.append((None, None, kind, key, source, no, p, top, rank, form, number, guarded, looks_running(t), keys))
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)
            if len(raw) > 200_000:
                yield flush(raw)
                raw = Counter()
        yield flush(raw)

    return df.mapInPandas(run, _CENSUS)


def rims(text: str) -> list[str]:
    """A line's first and last ten letters: what headers of different sources may have in common."""
    s, n = letters_of(text), len(text.split())
    return [f"<{n} {s[:10]}", f">{n} {s[-10:]}"] if len(s) >= 12 else []


#: Sources whose headers begin or end alike before the wording counts as a header's in any source.
COMMON_SOURCES = 5
#: Pages from one line of a wording to the next, on average, up to which it is repeated: chapters of a long source have
#: headers of their own, while like lines of its text are far between.
APART = 40


def furniture(edges: DataFrame) -> DataFrame:
    """(record_type, record_id, line_no, damage): headers and footers (``running``) and page labels (``pageno``).

    edges must be a written table, as its rows are numbered here. Wordings and labels travel as hashes with their source,
    and are aggregated over it before they meet the lines again.
    """
    edges = edges.withColumn("row_", F.monotonically_increasing_id())
    lines = edges.where("form IS NULL")
    close = F.col("b") - F.col("a") <= APART * (F.col("n") - 1)
    pages = lambda g: g.agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("a") < F.col("b")) & close)
    keyed = lines.select("row_", "source", "page", F.explode("keys").alias("key"))
    whole = keyed.where(~F.col("key").rlike("^[<>]")).select("row_", "page", F.xxhash64("source", "key").alias("key"))
    known = whole.join(pages(whole.groupBy("key")).select("key").hint("merge"), "key", "left_semi").select("row_").distinct()
    rim = keyed.where(F.col("key").rlike("^[<>]")).select("row_", F.xxhash64("source").alias("source"), F.xxhash64("key").alias("key"))
    wording = rim.join(known.hint("merge"), "row_", "left_semi").select("key", "source").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_SOURCES).select("key")
    alike = rim.join(wording.hint("merge"), "key", "left_semi").select("row_")
    running = known.unionByName(alike).unionByName(lines.where("titled").select("row_")).distinct()

    labels = edges.where("form IS NOT NULL").withColumn("step", F.xxhash64("source", "form", "top", F.col("number") - F.col("page")))
    steady = labels.join(pages(labels.groupBy("step")).select("step").hint("merge"), "step", "left_semi").select("row_")
    # A label stands at the very edge, or next to furniture that does.
    spot = F.xxhash64("record_type", "record_id", F.coalesce("page", F.lit(-1)), "top").alias("spot")
    outer = edges.where("rank = 0 AND form IS NULL").select("row_", spot).join(running.hint("merge"), "row_", "left_semi").select("spot")
    loose = labels.where(~F.col("guarded"))
    inner = loose.where("rank = 1").select("row_", spot).join(outer.hint("merge"), "spot", "left_semi").select("row_")
    pageno = steady.unionByName(loose.where("rank = 0").select("row_")).unionByName(inner)
    # A line is one or the other: the forms are apart.
    found = running.withColumn("damage", F.lit("running")).unionByName(pageno.distinct().withColumn("damage", F.lit("pageno")))
    return edges.select("row_", "record_type", "record_id", "line_no").join(found.hint("merge"), "row_").select("record_type", "record_id", "line_no", "damage").distinct()


def _lexicon(words: DataFrame, share: float) -> tuple[dict[str, int], int]:
    """(frequent words with their counts, how many words there are in all)."""
    total = words.agg(F.sum("n")).first()[0] or 0
    rows = words.where(F.col("n") >= max(LEAST, share * total)).where(~F.col("word").rlike("^[0-9]+$")).collect()
    return {r["word"]: r["n"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))}, total


def _suspects(words: DataFrame, counts: dict[str, int], least: float) -> dict[str, tuple[str, ...]]:
    """Rare words of at least ``least`` occurrences, so a number bounded by the share that is, which frequent words are
    plausible readings of."""
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(shared.value)
        for b in batches:
            found = [(w, list(e)) for w in b["word"] if w not in lexicon.words and (e := lexicon.edits(w))]
            yield pd.DataFrame(found, columns=["word", "edits"])

    rows = words.where((F.col("n") >= least) & ~F.col("word").rlike("^[0-9]+$")).select("word").mapInPandas(run, "word string, edits array<string>").collect()
    return {r["word"]: tuple(r["edits"]) for r in sorted(rows, key=lambda r: r["word"])}


def _pair_counts(df: DataFrame, index: dict[str, int], contexts: int) -> DataFrame:
    """(pair, n): how often a context word stands within the window of a word, pair being word number * contexts +
    context number. Only pairs that occur are counted, added up in each task and again before the shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value

        class Ids(dict):
            def __missing__(self, token: str) -> int:
                w = token_words(token)
                got = index.get(w[0], -1) if len(w) == 1 else -1
                if len(self) < 500_000:
                    self[token] = got
                return got

        ids = Ids()

        def pairs(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
            g = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
            out = []
            for o in range(1, WINDOW + 1):
                for a, b in ((g[:-o], g[o:]), (g[o:], g[:-o])):
                    k = (a >= 0) & (b >= 0) & (b < contexts)
                    out.append(a[k] * contexts + b[k])
            return np.unique(np.concatenate(out), return_counts=True)

        def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        total, held = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        for b in batches:
            for text in b["text"]:
                held += without_fragments(text).split()
                held.append("|")
                if len(held) > 500_000:
                    total, held = added([total, pairs(held)]), []
            if len(total[0]) > 2_000_000:
                yield pd.DataFrame({"pair": total[0], "n": total[1]})
                total = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        total = added([total, pairs(held)])
        yield pd.DataFrame({"pair": total[0], "n": total[1]})

    return df.select("text").mapInPandas(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def without_fragments(text: str) -> str:
    """The text with the pieces of words broken at line ends replaced by a sign that is no word."""
    out, at = [], 0
    for m in _CUT_WORD.finditer(text, 1):
        if text[m.start() - 1].isalnum() and m.start() > at:
            left = text[max(at, m.start() - 200) : m.start()]
            out.append(text[at : m.start() - len(left.split()[-1])] if left.split() else text[at : m.start()])
            at = m.end()
    return " | ".join([*out, text[at:]]) if out else text


def neighbours(js: np.ndarray, ns: np.ndarray, vectors: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Whether each frequent word is a neighbour of a rare word with ``ns`` occurrences of the contexts ``js``: unless it
    is less likely there than by chance, by far and beyond doubt."""
    u = ns.astype(np.float32) @ contexts[js]
    odds = vectors @ u + ns.sum() * np.log(NEGATIVES)
    return (odds >= -DOUBT) | (odds >= UNLIKE * ns.sum())


def _settled(rows: DataFrame, suspects: dict[str, tuple[str, ...]], index: dict[str, int], vectors: np.ndarray, contexts: np.ndarray) -> dict[str, tuple[str, ...]]:
    """For each suspect with contexts: those of its plausible readings that are its neighbours in the vector space, the
    most frequent first. rows: its (pair, n)."""
    sc = rows.sparkSession.sparkContext
    names = list(suspects)
    first, v = len(vectors), len(contexts)
    shared = sc.broadcast((names, suspects, index, vectors, contexts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, suspects, index, vectors, contexts = shared.value
        for b in batches:
            out = []
            for word, js, ns in zip(b["word"], b["js"], b["ns"]):
                name = names[word - first]
                readings = suspects[name]
                near = neighbours(np.asarray(js, np.int64), np.asarray(ns, np.int64), vectors[[index[w] for w in readings]], contexts)
                out.append((name, [w for w, k in zip(readings, near) if k]))
            yield pd.DataFrame(out, columns=["name", "links"])

    # At most as many pairs a word as there are contexts.
    each = rows.select((F.expr(f"pair div {max(v, 1)}")).alias("word"), (F.col("pair") % max(v, 1)).alias("j"), "n").groupBy("word").agg(F.collect_list("j").alias("js"), F.collect_list("n").alias("ns"))
    return {r["name"]: tuple(r["links"]) for r in each.mapInPandas(run, "name string, links array<string>").collect()}


def reader(scratch: Scratch, df: DataFrame, census: DataFrame, share: float = SHARE) -> tuple:
    """What a ``Reader`` is made of: the lexicon, at most 1/share words, with vectors; the context vectors of the first
    ``VECTOR_WORDS``; and the rare words that their vectors link with frequent ones, at most 1/``RARE_SHARE``."""
    words = scratch.keep(census.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    counts, total = _lexicon(words, share)
    suspects = _suspects(words, counts, max(LEAST, RARE_SHARE * total)) if counts else {}
    index = {w: i for i, w in enumerate(counts)}
    v = min(len(index), VECTOR_WORDS)
    pairs = np.zeros((len(index), v), np.float32)
    known: dict[str, tuple[str, ...]] = {}
    if v:
        rows = scratch.keep(_pair_counts(df, index | {w: len(index) + i for i, w in enumerate(suspects)}, v))
        own = rows.where(F.col("pair") < len(index) * v).toArrow()
        pairs.ravel()[own["pair"].to_numpy()] = own["n"].to_numpy()
    vectors, contexts = train_vectors(pairs)
    if suspects:
        known = _settled(rows.where(F.col("pair") >= len(index) * v), suspects, index, vectors, contexts)
    return counts, index, vectors, contexts, known


def damaged_lines(parts: list[Part], share: float = SHARE) -> DataFrame:
    """(record_type, record_id, line_no, damage): one row per damaged line and kind, lines counted from 1.

    Null texts give nothing; a record delivered twice gives its rows once. Lines in code fences and marker lines are
    never damaged. An empty input gives an empty table, texts too few for a lexicon only what needs none. Texts are read
    whole. A word beyond ASCII is judged as any other: by whether it is frequent, or linked with a frequent one.
    """
    df = records(parts)
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        census = scratch.keep(_census(df))
        made = spark.sparkContext.broadcast(reader(scratch, df, census, share))
        fixed = furniture(census.where("word IS NULL"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = Reader(*made.value)
            for b in batches:
                rows = []
                for kind, key, page, text, finished, paged in zip(b["record_type"], b["record_id"], b["page"], b["text"], b["finished"], b["paged"]):
                    if r.clean(text):
                        continue
                    lines = lines_of(text, None if pd.isna(page) else int(page))
                    found = {(no, d) for no, d, *_ in r.damage(lines, None if paged else frozenset(), bool(finished))}
                    rows += [(kind, key, no, d) for no, d in found]
                yield pd.DataFrame(rows, columns=["record_type", "record_id", "line_no", "damage"])

        lines = df.mapInPandas(run, "record_type string, record_id bigint, line_no bigint, damage string").distinct()
        at = ["record_type", "record_id", "line_no"]
        # One pass over the texts gives the lines; furniture goes before what is read in it.
        every = lines.withColumn("fixed", F.lit(False)).unionByName(fixed.withColumn("fixed", F.lit(True)))
        every = every.groupBy(*at).agg(F.max("fixed").alias("fixed"), F.max(F.when(F.col("fixed"), F.col("damage"))).alias("one"), F.collect_set("damage").alias("several"))
        return scratch.hand_over(every.select(*at, F.explode(F.when(F.col("fixed"), F.array("one")).otherwise(F.col("several"))).alias("damage")))


_ENDS = "record_type string, record_id bigint, source string, page int, text string, part string, first string, goes_on boolean, open boolean"


def repaired_texts(parts: list[Part], share: float = SHARE) -> DataFrame:
    """(record_type, record_id, text, continues): every text corrected and reflowed into paragraphs.

    A page of a source goes on where the page before ended: a word broken over the page end is put together on the page
    it begins, and ``continues`` tells that a text's first paragraph belongs to the last one of the page before, so that
    the pages of a source in order, joined with a blank or else a blank line, are continuous text. Where two records
    hold one page, its text goes on with that of the lesser id. A record delivered twice gives one row; null texts give
    none.
    """
    df = records(parts)
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        census = scratch.keep(_census(df))
        made = spark.sparkContext.broadcast(reader(scratch, df, census, share))
        at = ["record_type", "record_id"]
        drop = furniture(census.where("word IS NULL")).groupBy(*at).agg(F.collect_set("line_no").alias("drop"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = Reader(*made.value)
            for b in batches:
                rows = []
                for kind, key, source, page, text, finished, gone in zip(b["record_type"], b["record_id"], b["source"], b["page"], b["text"], b["finished"], b["drop"]):
                    lines = lines_of(text, None if pd.isna(page) else int(page))
                    fixed, part = r.repair(lines, frozenset() if gone is None else frozenset(gone), bool(finished))
                    head = re.match(r"([^\W_]+)[.,;:!?)]*(?:\s|$)", fixed)
                    rows.append((kind, key, source, page, fixed, part, head[1] if head and head[1][0].islower() else None, bool(re.match(r"[a-z]", fixed)), fixed[-1:] not in ".!?:" and not _LIST.match(fixed[fixed.rfind("\n") + 1 :])))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ENDS.split(", ")]).astype({"page": "Int32"})

        single = scratch.keep(df.join(drop.hint("merge"), at, "left").mapInPandas(run, _ENDS).dropDuplicates(at))
        here = ["record_type", "source", "page"]
        ends = single.where("page IS NOT NULL").groupBy(*here).agg(F.min(F.struct("record_id", "part", "first", "goes_on", "open")).alias("s")).select(*here, "s.*")
        before = ends.select("record_type", "source", (F.col("page") + 1).alias("page"), F.col("part").alias("part_before"), F.col("open").alias("open_before"))
        after = ends.select("record_type", "source", (F.col("page") - 1).alias("page"), F.col("first").alias("first_after"))
        out = single.join(before.hint("merge"), here, "left").join(after.hint("merge"), here, "left")
        whole = F.col("part").isNotNull() & F.col("first_after").isNotNull()
        rest = F.col("part_before").isNotNull() & F.col("first").isNotNull()
        text = F.when(rest, F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text"))
        text = F.when(whole, F.concat(text, "first_after")).otherwise(text)
        return scratch.hand_over(out.select(*at, text.alias("text"), F.coalesce(rest | F.col("open_before") & F.col("goes_on"), F.lit(False)).alias("continues")))
