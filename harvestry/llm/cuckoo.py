"""A cuckoo filter in numpy: 16-bit fingerprints, buckets of four, bulk insertion, deletion."""

from __future__ import annotations

import numpy as np

SLOTS, MAX_KICKS = 4, 500


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CuckooFilter:
    """May say yes to a key never inserted, never no to one that is. Only keys that were inserted may be deleted."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.8)))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(np.asarray(keys, np.int64).view(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & self.mask).astype(np.int64)
        return prints, first, self._other(prints, first)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(prints) & self.mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Insert distinct keys; False if the filter is too full, which leaves it unusable."""
        prints, a, b = self._places(keys)
        for _ in range(2):  # into either of the two buckets, as many at once as there is room
            placed = self._place(prints, a)
            prints, a, b = prints[~placed], b[~placed], a[~placed]
            if not len(prints):
                return True
        rng = np.random.default_rng(0)
        for f, i in zip(prints.tolist(), a.tolist()):
            for _ in range(MAX_KICKS):
                free = np.flatnonzero(self.table[i] == 0)
                if len(free):
                    self.table[i, free[0]] = f
                    break
                slot = int(rng.integers(SLOTS))
                f, self.table[i, slot] = int(self.table[i, slot]), f
                i = int(self._other(np.array([f], np.uint16), np.array([i]))[0])
            else:
                return False
        return True

    def _place(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put each fingerprint into a free slot of its bucket where there is one."""
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_, "left")
        free = self.table[sorted_] == 0
        ok = rank < free.sum(1)
        slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
        self.table[sorted_[ok], slot[ok]] = prints[order[ok]]
        placed = np.zeros(len(order), bool)
        placed[order[ok]] = True
        return placed

    def delete(self, keys: np.ndarray) -> None:
        prints, a, b = self._places(keys)
        for f, i, j in zip(prints.tolist(), a.tolist(), b.tolist()):
            for bucket in (i, j):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
