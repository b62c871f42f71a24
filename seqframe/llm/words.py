"""Words of many texts at once, hashed with array operations.

A word is a maximal run of [0-9a-z] and code points from U+0080, after A-Z is lower-cased; it never crosses texts.
Its hash is a polynomial in a random odd base over random values of its bytes, modulo 2**64, mixed at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix

#: Byte to byte: A-Z to lower case, all that no word holds to a space.
FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    FOLD[_a : _b + 1] = np.arange(_a, _b + 1)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(1 << max(16, (n - 1).bit_length()), np.uint64(base))
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


@dataclass
class Words:
    """Of all texts, in order: hash, first byte, byte after the last; first word of each text (n + 1 entries)."""

    folded: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 as one string, a space between two: what exact checks compare."""
        return b" ".join(self.folded[a:b].tobytes() for a, b in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist(), strict=True))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    folded = FOLD[data]
    inside = folded != 32
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    value = _VALUES[folded]
    value *= powers(_BASE, len(data))
    sums = np.cumsum(value, dtype=np.uint64)
    hashes = sums[ends - 1] - sums[starts] + value[starts]
    hashes *= powers(_INVERSE, len(data))[starts] if len(data) else hashes
    return Words(folded, mix(hashes), starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; those that cross texts are for the caller to leave out."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + m]
    return mix(out)


def owner(first: np.ndarray) -> np.ndarray:
    """Of each word, the text that it is in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
