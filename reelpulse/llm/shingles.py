"""Word shingles of texts as 64-bit hashes, with term counts; numpy inside tasks."""

from __future__ import annotations

import numpy as np

from .words import TABLE

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """Hashes of words by prefix sums of a polynomial modulo 2^64; keeps its powers between texts."""

    def __init__(self):
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        self.powers = np.full(n, _BASE, np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        self.inverses = np.full(n, inverse, np.uint64)
        self.inverses[0] = 1
        np.cumprod(self.inverses, out=self.inverses)

    def words(self, text: str | None) -> np.ndarray:
        """One hash per word of the text, in order (see the words module for what a word is)."""
        if not text:
            return np.empty(0, np.uint64)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(TABLE), np.uint8)
        if len(raw) > len(self.powers):
            self._grow(2 * len(raw))
        inside = np.concatenate([[False], raw != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw.astype(np.uint64) * self.powers[:len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingle hashes, ascending; how often each occurs).  A text of fewer words than a shingle
        has one shingle of all its words; a text without words has none."""
        w = self.words(text)
        if not len(w):
            return w, np.empty(0, np.int64)
        n = max(1, len(w) - WORDS + 1)
        total = np.zeros(n, np.uint64)
        for i in range(min(WORDS, len(w))):
            total = mix(total * _U(3) + w[i:i + n] + _U(i))
        return np.unique(total, return_counts=True)
