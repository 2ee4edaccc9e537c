"""A bidirectional FM-index over delimited words and its search schemes, for many queries at once.

The words w1..wk stand in a cyclic text ``0 w1 0 w2 .. 0 wk``. The index keeps its Burrows-Wheeler transform and that of
the reversed text; a pattern is a pair of suffix-rank intervals of one size, one in each, and grows by a letter at
either end. Every step is done for whole arrays of queries."""

from __future__ import annotations

import numpy as np

#: Queries that are extended together.
BATCH = 8192


def rotation_order(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a primitive cyclic text of codes below 256 in sorted order: eight letters at once, then
    by doubling."""
    n = len(text)
    packed = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        packed = (packed << np.uint64(8)) | np.roll(text, -i).astype(np.uint64)
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    width = 8
    while True:
        key = rank * (n + 1) + np.roll(rank, -width)
        order = np.argsort(key)
        ordered = key[order]
        steps = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        width *= 2
        if steps[-1] == n - 1:
            return order
        if width >= 2 * n:
            raise ValueError("words are not distinct")


class Ranks:
    """How many of the first ``at`` letters of a transform are below a letter: for each letter a bitmap with counts."""

    def __init__(self, transform: np.ndarray, letters: int):
        n = len(transform)
        blocks = n // 64 + 1
        self.bits = np.zeros((letters + 1, blocks), dtype=np.uint64)
        self.before = np.zeros((letters + 1, blocks), dtype=np.int64)
        flags = np.zeros(blocks * 64, dtype=bool)
        for c in range(1, letters + 1):
            flags[:n] = transform < c
            self.bits[c] = np.packbits(flags, bitorder="little").view(np.uint64)
            self.before[c, 1:] = np.cumsum(np.bitwise_count(self.bits[c]), dtype=np.int64)[:-1]

    def below(self, c, at) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[c, block] + np.bitwise_count(self.bits[c, block] & mask)

    def below_each(self, at: np.ndarray) -> np.ndarray:
        """A row per place, a column per letter and one for all of them."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return (self.before[:, block] + np.bitwise_count(self.bits[:, block] & mask[None, :])).T


class States:
    """Patterns under way: the query, its interval in the searched direction, the start of that in the other one, and
    the size of both."""

    __slots__ = ("query", "lo", "other", "size")

    def __init__(self, query, lo, other, size):
        self.query, self.lo, self.other, self.size = query, lo, other, size

    def where(self, mask: np.ndarray) -> "States":
        return States(self.query[mask], self.lo[mask], self.other[mask], self.size[mask])

    def turned(self) -> "States":
        """The same patterns for extension at the other end."""
        return States(self.query, self.other, self.lo, self.size)

    def with_(self, more: "States") -> "States":
        return States(*(np.concatenate((getattr(self, k), getattr(more, k))) for k in States.__slots__))


class WordIndex:
    def __init__(self, words: list[bytes]):
        """``words``: distinct, not empty, without zero bytes."""
        self.words = words
        raw = np.frombuffer(b"\0" + b"\0".join(words), dtype=np.uint8)
        used = np.unique(raw)
        self.code = np.full(256, -1, dtype=np.int64)
        self.code[used] = np.arange(len(used))
        self.letters = len(used)
        text = self.code[raw]
        order = rotation_order(text)
        self.size = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.letters))))
        number = np.cumsum(text == 0) - 1
        self.word_at = number[order]
        backwards = text[::-1]
        self.left = Ranks(text[order - 1], self.letters)  # letters before a pattern
        self.right = Ranks(backwards[rotation_order(backwards) - 1], self.letters)  # letters after it

    def _step(self, ranks: Ranks, at: States, c: np.ndarray) -> States:
        """Extended by one letter each (-1: a letter that no word has)."""
        known = c >= 0
        if not known.all():
            at, c = at.where(known), c[known]
        hi = at.lo + at.size
        below_lo, upto_lo = ranks.below(c, at.lo), ranks.below(c + 1, at.lo)
        below_hi, upto_hi = ranks.below(c, hi), ranks.below(c + 1, hi)
        size = (upto_hi - below_hi) - (upto_lo - below_lo)
        grown = States(at.query, self.first[c] + upto_lo - below_lo, at.other + below_hi - below_lo, size)
        return grown.where(size > 0)

    def _branch(self, ranks: Ranks, at: States) -> tuple[States, np.ndarray]:
        """Extended by every letter but the delimiter that occurs there; and which letter it was."""
        lo, hi = ranks.below_each(at.lo), ranks.below_each(at.lo + at.size)
        size = np.diff(hi, axis=1) - np.diff(lo, axis=1)
        size[:, 0] = 0
        i, c = np.nonzero(size)
        grown = States(at.query[i], self.first[c] + lo[i, c + 1] - lo[i, c], at.other[i] + hi[i, c] - lo[i, c], size[i, c])
        return grown, c

    def near(self, queries: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that differ from a query by one letter replaced inside of [start, end), or by one letter more, put in
        there or at an end of it. ``queries`` are equally long words, one a row (uint8). The rest of the word is matched
        exactly first, and the delimiters make whole words of the matches. Returns rows of ``queries`` and numbers of
        words, each pair once."""
        length = queries.shape[1]
        if not 0 <= start < end <= length or (start, end) == (0, length):
            raise ValueError("a part of the query has to be exact")
        found = [np.zeros(0, dtype=np.int64)]
        for low in range(0, len(queries), BATCH):
            codes = self.code[queries[low : low + BATCH]]
            if start:
                hits = self._search(codes, start, end, self.left, self.right)
            else:  # the mirror image: an exact ending, and errors before it
                hits = self._search(codes[:, ::-1], length - end, length, self.right, self.left)
            found.append((hits.query + low) * len(self.words) + hits.lo)
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.words), pairs % len(self.words)

    def _search(self, codes: np.ndarray, start: int, end: int, left: Ranks, right: Ranks) -> States:
        """Exact [0, start) from its last letter to the delimiter, then the rest at the other end, with one error
        inside of [start, end). ``lo`` of what returns is a number of a word."""
        n, length = codes.shape
        zero = np.zeros(n, dtype=np.int64)
        exact = States(np.arange(n), zero, zero, np.full(n, self.size, dtype=np.int64))
        for p in range(start - 1, -1, -1):
            exact = self._step(left, exact, codes[exact.query, p])
        exact = self._step(left, exact, np.zeros(len(exact.query), dtype=np.int64)).turned()

        wrong = exact.where(np.zeros(len(exact.query), dtype=bool))
        for p in range(start, length):
            replaced = None
            if p <= end and len(exact.query):
                grown, c = self._branch(right, exact)
                own = codes[grown.query, p]
                # A letter put in before its like is the same as one put in after it, but for the last place.
                wrong = wrong.with_(grown if p == end else grown.where(c != own))
                if p < end:
                    replaced = grown.where(c != own)
                    exact = grown.where(c == own)
            wrong = self._step(right, wrong, codes[wrong.query, p])
            if replaced is not None:
                wrong = wrong.with_(replaced)
            if not len(wrong.query) and (p >= end or not len(exact.query)):
                return wrong
        if end == length and len(exact.query):
            wrong = wrong.with_(self._branch(right, exact)[0])
        wrong = self._step(right, wrong, np.zeros(len(wrong.query), dtype=np.int64))
        # Whole words: the interval of the forward transform has one row, whose rotation starts at the word's delimiter.
        rows = wrong.other if right is self.right else wrong.lo
        return States(wrong.query, self.word_at[rows], rows, wrong.size)
