"""A cuckoo filter over 64-bit hashes, whose bulk operations are array operations.

A key has a 16-bit fingerprint and two buckets of four slots: i and i XOR hash(fingerprint). A lookup sees both; a
deletion clears one slot with the fingerprint. The number of buckets is a power of two; a filter that fills up is
rebuilt at twice the size from the exact keys that back it, so nothing inserted is ever lost.
"""

from __future__ import annotations

import numpy as np

from .common import mix

SLOTS, KICKS = 4, 500


class Full(Exception):
    """No place was found; rebuild at twice the size."""


class CuckooFilter:
    def __init__(self, buckets: int, table: np.ndarray | None = None):
        assert buckets & (buckets - 1) == 0
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8))))))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these distinct keys, large enough for all."""
        size = cls.sized(len(keys)).table.shape[0]
        while True:
            try:
                (made := cls(size)).insert(keys)
                return made
            except Full:
                size *= 2

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = mix(keys.astype(np.uint64))
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = keys & self.mask
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ (mix(np.asarray(prints, np.uint64) + np.uint64(0x51ED27)) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for all inserted keys, and for about 8 in 65,536 others."""
        prints, a, b = self.places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        prints, a, b = self.places(keys)
        rest = np.arange(len(keys))
        for where in (a, b):  # in bulk: per round, each bucket takes one of the keys that wish to go there
            for _ in range(SLOTS):
                if not len(rest):
                    return
                _, chosen = np.unique(where[rest], return_index=True)
                rows = where[rest[chosen]].astype(np.int64)
                free = self.table[rows] == 0
                ok = free.any(axis=1)
                self.table[rows[ok], free[ok].argmax(axis=1)] = prints[rest[chosen[ok]]]
                rest = np.delete(rest, chosen[ok])
        rng = np.random.default_rng(1)
        for i in rest.tolist():
            self._kick(int(a[i]), int(prints[i]), rng)

    def _kick(self, bucket: int, mark: int, rng: np.random.Generator) -> None:
        for turn in range(KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return
            if turn:
                slot = int(rng.integers(SLOTS))
                row[slot], mark = mark, int(row[slot])
            bucket = int(self.other(np.uint64(bucket), np.uint16(mark)))
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Of keys that were inserted; each frees one slot."""
        for mark, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)
