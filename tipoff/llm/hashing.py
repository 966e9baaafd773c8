"""Vectorised 64-bit hashes of words and byte strings; all arithmetic is modulo 2^64."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A fixed odd-looking 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    size = 1 << max(16, (n - 1).bit_length())
    p, q = _powers(size)
    return p[:n], q[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of any substrings of one byte array in constant time each."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(byte_values()[data] * self.power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def windows(self, width: int) -> np.ndarray:
        """Hash of each window of `width` bytes."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of each maximal run of bytes other than 9-13 and 32, in order."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.astype(np.int8)])))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Prefix(data).of(start, end), np.searchsorted(ends, start, "right")


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `width`-word shingles of each text, sorted, and where each text's begin (n_texts + 1 numbers).
    A text with fewer words has the whole sequence as its one shingle; one without words has none."""
    count = np.bincount(owner, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(hashes)
    h = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        h = h * np.uint64(BASE) + hashes[k : n - width + 1 + k] if len(h) else h
    keep = owner[: len(h)] == owner[width - 1 :] if len(h) else np.empty(0, bool)
    rows, values = owner[: len(h)][keep], mixed(h[keep])
    short = np.flatnonzero((count > 0) & (count < width))
    extra = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        for w in hashes[first[t] : first[t + 1]].tolist():
            extra[i] = (int(extra[i]) * BASE + w + 1) & _MASK
    rows, values = np.concatenate([rows, short]), np.concatenate([values, mixed(extra + np.uint64(width))])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(n_texts + 1))
