"""Evaluation passages inside training text, by suffix arrays over the training words.

The corpus is read in shards of whole documents. A shard's words become numbers (0 for words no test item has), its
suffixes are sorted into an array, and every suffix of every test item is looked up in it by binary search; the equal
range holds all verbatim matches of at least ``min_words`` words with their places, which are then followed to their
full length. Suffixes that meet a foreign word or the end of their document too soon for a match are left out of the
array: they could never be in such a range.

Only the test set is sent to the tasks. Its size is checked; a test set above the bound is taken in blocks, each against
all of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine.batches import keyed, restored
from millrace.engine.session import Scratch

MIN_WORDS = 12
#: Characters of test text sent to tasks at once.
BLOCK_CHARS = 8_000_000
#: Matches that are followed at once.
AT_ONCE = 2_000_000
#: Words of a shard. A longer document is a shard by itself.
SHARD_WORDS = 1_000_000

_WORD = re.compile(rb"[a-z0-9]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


def _keys(a: np.ndarray, at: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """The first ``depth`` numbers from each place, packed in order into 64-bit columns."""
    per, out = 64 // bits, []
    for lo in range(0, depth, per):
        key = np.zeros(len(at), np.uint64)
        for k in range(lo, min(depth, lo + per)):
            key = (key << np.uint64(bits)) | a[at + k]
        out.append(key)
    return out


def _less(a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], or_equal: bool) -> np.ndarray:
    """Whether suffix i of ``a`` comes before (or is equal to) the suffix in the same row of ``b``."""
    less, same = np.zeros(len(i), bool), np.ones(len(i), bool)
    for x, y in zip(a, b):
        v = x[i]
        less |= same & (v < y)
        same &= v == y
    return less | same if or_equal else less


def _bound(array: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of all wanted suffixes at once."""
    n = len(wanted[0])
    lo, hi = np.zeros(n, np.int64), np.full(n, len(array[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        low = _less(array, np.minimum(mid, len(array[0]) - 1), wanted, right) & open_
        lo, hi = np.where(low, mid + 1, lo), np.where(open_ & ~low, mid, hi)
    return lo


class TestSet:
    """Numbered words of the test items and all their suffixes of at least ``min_words``."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], min_words: int) -> None:
        self.min, self.ids, self.number = min_words, [], {}
        parts, at, item = [np.zeros(1, np.uint64)], [], []
        start = 1
        for key, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text)]
            if len(w) >= min_words:
                at.append(np.arange(start, start + len(w) - min_words + 1))
                item.append(np.full(len(w) - min_words + 1, len(self.ids)))
                self.ids.append(key)
                parts += [np.array(w, np.uint64), np.zeros(1, np.uint64)]
                start += len(w) + 1
        self.words = np.concatenate(parts)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.bits = 16 if len(self.number) < 2**16 - 1 else 32
        self.keys = _keys(self.words, self.at, min_words, self.bits)

    def matches(self, docs: list[list[bytes]]) -> pd.DataFrame:
        """(doc, item, words, doc_start, item_start): the longest match of each document and item, its first place."""
        number, n = self.number.get, self.min
        flat = np.fromiter((y for d in docs for x in (d, (None,)) for y in ((number(w, 0) if w is not None else 0) for w in x)), np.uint64)
        empty = pd.DataFrame({"doc": [], "item": [], "words": [], "doc_start": [], "item_start": []}, dtype=np.int64)
        if len(flat) < n or not len(self.at):
            return empty
        foreign = np.concatenate([[0], np.cumsum(flat == 0)])
        places = np.flatnonzero(foreign[n:] == foreign[:-n])
        if not len(places):
            return empty
        keys = _keys(flat, places, n, self.bits)
        order = np.lexsort(keys[::-1])
        array, places = [k[order] for k in keys], places[order]
        lo, hi = _bound(array, self.keys, False), _bound(array, self.keys, True)
        many = hi - lo
        total = int(many.sum())
        if not total:
            return empty
        starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
        # Some test suffixes at a time, as a passage that many documents and items share has many matches.
        part = np.cumsum(many) // AT_ONCE
        found = [self._followed(flat, places, starts, np.flatnonzero(part == k), lo, many) for k in np.unique(part[many > 0])]
        return _longest(pd.concat(found, ignore_index=True))

    def _followed(self, flat: np.ndarray, places: np.ndarray, starts: np.ndarray, some: np.ndarray, lo: np.ndarray, many: np.ndarray) -> pd.DataFrame:
        """The matches of some test suffixes to their full length; lo and many: their ranges in the array of places."""
        lo, many, n = lo[some], many[some], self.min
        suffix = np.repeat(some, many)
        place = places[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        # Only where the words before differ does a match begin; the others are parts of one that is found anyway.
        begins = (place == 0) | (flat[place - 1] == 0) | (flat[place - 1] != self.words[self.at[suffix] - 1])
        suffix, place = suffix[begins], place[begins]
        source = self.at[suffix]
        length = np.full(len(place), n)
        live = np.arange(len(place))
        while len(live):
            p, q = place[live] + length[live], source[live] + length[live]
            inside = (p < len(flat)) & (q < len(self.words))
            live, p, q = live[inside], p[inside], q[inside]
            more = (flat[p] == self.words[q]) & (self.words[q] != 0)
            live = live[more]
            length[live] += 1
        doc = np.searchsorted(starts, place, "right") - 1
        first = np.searchsorted(self.item, self.item[suffix])
        return _longest(pd.DataFrame({"doc": doc, "item": self.item[suffix], "words": length, "doc_start": place - starts[doc] + 1, "item_start": source - self.at[first] + 1}))


def _longest(found: pd.DataFrame) -> pd.DataFrame:
    """One row per document and item: the longest match, its first place."""
    found = found.sort_values(["doc", "item", "words", "doc_start", "item_start"], ascending=[True, True, False, True, True])
    return found.drop_duplicates(["doc", "item"])


def find_leaks(
    corpus: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, item, matched_words, doc_start, item_start): one row per document and test item that share at least
    ``min_words`` consecutive words, with the longest shared run and where it begins (word places from 1).

    Null, blank and short texts of either side match nothing. Repeated rows give repeated rows. Whole texts are read,
    of any length. An empty test set or corpus gives an empty table. Several equally long runs: the first place counts.
    """
    sizes = tests.where(F.col(item_text).isNotNull()).agg(F.sum(F.length(item_text)), F.count(F.lit(1))).first()
    blocks = max(1, -(-(sizes[0] or 0) // block_chars))
    kind, item_kind = corpus.schema[id_col].dataType.simpleString(), tests.schema[item_col].dataType.simpleString()
    docs = corpus.where(F.col(text_col).isNotNull()).select(keyed(id_col), F.col(text_col).alias("text_"))

    def against(k: int) -> tuple[Broadcast, DataFrame]:
        rows = tests.where(F.col(item_text).isNotNull()).where(F.pmod(F.xxhash64(item_col, item_text), F.lit(blocks)) == k).select(keyed(item_col, "item_"), item_text).collect()
        shared = corpus.sparkSession.sparkContext.broadcast(TestSet(sorted(((r[0], r[1]) for r in rows), key=lambda r: (str(r[0]), r[1])), min_words))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            test = shared.value
            ids, held, n = [], [], 0

            def shard() -> pd.DataFrame:
                m = test.matches(held)
                return pd.DataFrame(
                    {"id_": pd.Series([ids[i] for i in m["doc"]], dtype=object), "item_": pd.Series([test.ids[i] for i in m["item"]], dtype=object), "matched_words": m["words"].to_numpy(), "doc_start": m["doc_start"].to_numpy(), "item_start": m["item_start"].to_numpy()}
                )

            for b in batches:
                for key, text in zip(b["id_"], b["text_"]):
                    w = words(text)
                    if len(w) < test.min:
                        continue
                    if n and n + len(w) > SHARD_WORDS:
                        yield shard()
                        ids, held, n = [], [], 0
                    ids.append(key)
                    held.append(w)
                    n += len(w)
            if held:
                yield shard()

        return shared, docs.mapInPandas(run, "id_ string, item_ string, matched_words bigint, doc_start bigint, item_start bigint")

    if blocks == 1:
        out = against(0)[1]
    else:
        # One block is on the driver at a time: its matches are written before the next is read.
        with Scratch(corpus.sparkSession) as scratch:
            parts = []
            for k in range(blocks):
                shared, found = against(k)
                parts.append(scratch.keep(found))
                shared.destroy()
            out = scratch.hand_over(reduce(DataFrame.unionByName, parts))
    return restored(restored(out, id_col, kind), item_col, item_kind, "item_")


def without_leaks(corpus: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The corpus without the documents that give test items away; rows without an id stay."""
    return corpus.join(leaks.select(F.col(id_col).alias("leaked_")).distinct(), F.col(id_col) == F.col("leaked_"), "left_anti")
