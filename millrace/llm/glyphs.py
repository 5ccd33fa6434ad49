"""Words as scanners misread them: folded shapes, links from rare to frequent words, and skip-gram vectors."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Letters and signs that scanners take for one another, under one representative each; then pairs that
#: look like one letter, in terms of those.
LETTERS = str.maketrans(
    {
        "0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "j": "l", "5": "s", "$": "s", "9": "g", "q": "g", "6": "b", "h": "b", "8": "b",
        "c": "e", "€": "e", "†": "t", "f": "t", "2": "z", "@": "a", "v": "y", "¢": "e", "ø": "o",
    }
)
PAIRS = ("ll", "u"), ("rn", "m"), ("rl", "n"), ("nn", "m"), ("el", "d"), ("yy", "w")

#: Words drawn by chance for each pair of the skip-gram objective.
NEGATIVES = 5


def plain(word: str) -> str:
    """Lower case, without accents and ligatures."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def folded(word: str, pairs: tuple = PAIRS) -> str:
    """The shape of a word: words a scanner could take for one another mostly have one shape."""
    w = plain(word).translate(LETTERS)
    for many, one in pairs:
        if many in w:
            w = w.replace(many, one)
    return w


def shapes(word: str) -> set[str]:
    """Its shapes when overlapping pairs are taken from either side, and with h as the two letters it may stand for."""
    out = {folded(word), folded(word, PAIRS[::-1]), folded(word[::-1], tuple((m[::-1], o) for m, o in PAIRS))[::-1]}
    if "h" in word or "li" in word:
        out.add("+" + folded(word.replace("h", "li")))
    return out


def _deletions(shape: str) -> set[str]:
    return {shape} | {shape[:i] + shape[i + 1 :] for i in range(len(shape))}


def _one_stroke(rare: str, word: str) -> bool:
    """Whether the two differ, besides like shapes, in one sign that is no plain letter, or by one run of strokes."""
    a = 0
    while a < min(len(rare), len(word)) and rare[a] == word[a]:
        a += 1
    b = 0
    while b < min(len(rare), len(word)) - a and rare[-1 - b] == word[-1 - b]:
        b += 1
    x, y = rare[a : len(rare) - b], word[a : len(word) - b]
    if len(x) == 1 and len(y) <= 2 and not (x.isascii() and x.isalpha()):
        return True
    return any(not (c.isascii() and c.isalpha()) for c in x) and abs(len(x) - len(y)) <= 1 and _matched(x, y)


def _matched(x: str, y: str) -> bool:
    return len(x) == len(y) and sum(folded(p) != folded(q) for p, q in zip(x, y)) <= 1


class Lexicon:
    """The frequent words of a corpus and what rare words may be read as."""

    def __init__(self, counts: dict[str, int], known: dict[str, tuple[str, ...]] | None = None) -> None:
        """known: readings of rare words that their contexts have settled."""
        self.counts = counts
        self.known = known or {}
        self.words = set(counts)
        self.by_shape: dict[str, list[str]] = {}
        self.by_deletion: dict[str, list[str]] = {}
        for w in counts:
            for s in shapes(w):
                self.by_shape.setdefault(s, []).append(w)
            if len(w) >= 4:
                for d in _deletions(w) | _deletions(folded(w)):
                    self.by_deletion.setdefault(d, []).append(w)
        self.starts = {w[:i] for w in counts for i in range(1, len(w) + 1)}
        self.ends = {w[i:] for w in counts for i in range(len(w))}
        self.heads: dict[str, int] = {}
        self.openings: dict[str, int] = {}
        for w, n in counts.items():
            for i, c in enumerate(w):
                if c == "-":
                    self.heads[w[:i]] = self.heads.get(w[:i], 0) + n
            if "-" not in w:
                for i in range(2, len(w) - 1):
                    self.openings[w[:i]] = self.openings.get(w[:i], 0) + n
        self.parts = {p for w in counts if "-" in w for p in w.split("-")}
        self.memo: dict[str, tuple[str, ...]] = {}

    def links(self, word: str) -> tuple[str, ...]:
        """Frequent words that a rare word is a plausible misreading of, best first: neighbours in the vector space where
        the word's contexts are known."""
        got = self.known.get(word)
        return self.edits(word) if got is None else got

    def edits(self, word: str) -> tuple[str, ...]:
        """Frequent words of a word's shape or one stroke from it, most frequent first, whatever the contexts."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            found = {w for s in shapes(word) for w in self.by_shape.get(s, ())}
            if not found and len(word) >= 4:
                bare = plain(word)
                near = {w for s in (bare, folded(word)) for d in _deletions(s) for w in self.by_deletion.get(d, ())}
                # Scanners take letters for like ones; another letter instead, or one more or less, is another word.
                found = {w for w in near if abs(len(w) - len(bare)) <= 2 and _one_stroke(bare, w)}
            found.discard(word)
            got = self.memo[word] = tuple(sorted(found, key=lambda w: (-self.counts[w], w)))
        return got


def train_vectors(pairs: np.ndarray, size: int = 32, negatives: int = NEGATIVES, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(word vectors, context vectors) of skip-gram with negative sampling.

    pairs[i, j] counts how often context word j is within the window of word i; the contexts are the first of the words.
    The objective is that of stochastic training, summed over all pairs, with the expected instead of drawn negatives; it
    is followed by full gradients with adaptive steps, so the result depends on no order of the text.
    """
    n, v = pairs.shape
    if not n:
        return np.zeros((0, size), np.float32), np.zeros((0, size), np.float32)
    rng = np.random.default_rng(seed)
    w, c = (rng.normal(0, 0.1, (k, size)).astype(np.float32) for k in (n, v))
    total = max(1.0, float(pairs.sum()))
    row, col = pairs.sum(1), pairs.sum(0).astype(np.float64) ** 0.75
    push = (negatives * row[:, None] * (col / max(col.sum(), 1e-9))[None] / total).astype(np.float32)
    pull = (pairs / total).astype(np.float32)
    # Square roots weigh rare words up, as subsampling of frequent words does.
    damp = (1 / np.sqrt(np.maximum(row, 1) / total)).astype(np.float32)
    pull, push = pull * damp[:, None], push * damp[:, None]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)]
    for t in range(1, rounds + 1):
        s = 1 / (1 + np.exp(-np.clip(w @ c.T, -15, 15)))
        g = pull * (s - 1) + push * s
        for x, grad, m, v2 in ((w, g @ c, state[0], state[1]), (c, g.T @ w, state[2], state[3])):
            m *= 0.9
            m += 0.1 * grad
            v2 *= 0.99
            v2 += 0.01 * grad * grad
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.99**t)) + 1e-9)
    return w, c
