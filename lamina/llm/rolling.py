"""Vectorised hashes of byte ranges: prefix sums of a polynomial in the ring of 64-bit integers."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_MASK = 2**64
_powers: dict[bool, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), pow(BASE, -1, _MASK) if inverse else BASE, np.uint64)
        steps[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Ranges:
    """Hashes of ranges of one byte string; equal ranges have equal hashes wherever they start."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data), False), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power(len(self.sums), True)[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all ranges of `width` bytes."""
        return mix((self.sums[width:] - self.sums[:-width]) * _power(len(self.sums) - width, True))
