"""Vectorised hashes of byte strings, words and word shingles."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd base; its powers and their inverses modulo 2^64 give the hash of any substring from one running sum.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    def __init__(self, base: int = BASE):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(m - 1, x, U)])) for x in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def running(data: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Running sums of a byte array, from which `between` takes hashes."""
    return summed(data, powers.upto(len(data))[0])


def summed(data: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Running sums of the bytes, each plus one and times its factor; in place, as there may be many."""
    total = np.zeros(len(data) + 1, U)
    part = total[1:]
    part[:] = data
    part += U(1)
    part *= factors
    np.cumsum(part, out=part)
    return total


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Hashes of the bytes from each start to each end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers.upto(len(sums))[1][start])


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word; words are what stands between ASCII white space."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, U)
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return between(running(data), edges[::2], edges[1::2])


def shingles(text: str, width: int = 5) -> np.ndarray:
    """A hash of each run of `width` words; a shorter text is one shingle of its words, one without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, U)
    for i in range(min(width, len(words))):
        h = h * U(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(h)


def counted(h: np.ndarray) -> np.ndarray:
    """Each hash with the number of its earlier occurrences mixed in: a multiset as a set."""
    h = np.sort(h)
    if not len(h):
        return h
    new = np.concatenate([[True], h[1:] != h[:-1]])
    occurrence = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return mix(h + U(0xA0761D6478BD642F) * occurrence.astype(U))
