"""Words of a text as numpy arrays: one hash per word ``[^\\x20\\x09-\\x0D]+``, and what it is made of."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """MULTIPLIER to the power 0..n-1, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        _POWERS[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, MULTIPLIER, np.uint64))])
    return _POWERS[0]


class Words:
    """The words of UTF-8 bytes: ``letters`` are the words' bytes one after another, ``first`` where each begins there,
    ``length`` its bytes, ``hash`` 64 bits that depend on its bytes only."""

    def __init__(self, raw: bytes, lower: bool = False):
        a = np.frombuffer(raw, np.uint8)
        if lower:
            a = np.where((a >= 65) & (a <= 90), a + np.uint8(32), a)
        space = IS_SPACE[a]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.n = len(starts)
        self.letters = a[~space]
        self.length = ends - starts
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1].astype(np.int64)
        if self.n:
            at = np.arange(len(self.letters)) - np.repeat(self.first, self.length)
            terms = (self.letters.astype(np.uint64) + np.uint64(1)) * powers(int(self.length.max()))[at]
            self.hash = scramble(np.add.reduceat(terms, self.first))
        else:
            self.hash = np.zeros(0, np.uint64)

    def count(self, member: np.ndarray) -> np.ndarray:
        """Bytes of each word for which the 256-entry table ``member`` is true."""
        if not self.n:
            return np.zeros(0, np.int64)
        return np.add.reduceat(member[self.letters].astype(np.int64), self.first)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, in order."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * MULTIPLIER + h[k : k + m]
    return scramble(out)


def byte_set(chars: str | bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return table
