"""Word-shingle sets of texts as sorted arrays of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from millrace.llm.text import FOLD_BYTES

FOLD = np.frombuffer(FOLD_BYTES, np.uint8)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: An odd base of the hash of a word's bytes, and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


class Hasher:
    """Keeps the powers of BASE between texts."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.powers = np.cumprod(np.concatenate((one, np.full(n, BASE))))
            self.inverses = np.cumprod(np.concatenate((one, np.full(n, INVERSE))))

    def words(self, text: str | None) -> np.ndarray:
        """A hash of each word, in order; A-Z as a-z."""
        data = FOLD[np.frombuffer((text or "").encode(), np.uint8)]
        solid = ~SPACE[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        self._grow(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * self.powers[: len(data)])))
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts])

    def shingles(self, text: str | None, k: int) -> np.ndarray:
        """The sorted distinct hashes of the k-word shingles; of fewer words, of the whole sequence; none without words."""
        words = self.words(text)
        n = min(k, len(words))
        if not n:
            return words
        out = np.full(len(words) - n + 1, np.uint64(n * 0x5851F42D4C957F2D % 2**64))
        for i in range(n):
            out = mixed(out * BASE + words[i : len(words) - n + 1 + i])
        return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def overlaps(a: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Sizes of the intersections of a sorted distinct array with each of others; none is empty."""
    if not others:
        return []
    flat = np.concatenate(others)
    at = np.searchsorted(a, flat)
    at[at == len(a)] = 0
    starts = np.cumsum([0, *(len(b) for b in others[:-1])])
    return np.add.reduceat(a[at] == flat, starts, dtype=np.int64).tolist()
