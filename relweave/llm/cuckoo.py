"""A cuckoo filter over 64-bit key hashes, built with array operations."""

from __future__ import annotations

import numpy as np

_SLOTS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Buckets of four 16-bit marks; a key may sit in one of two buckets, the
    second computed from the first and the mark alone, so keys can move and can
    be deleted. A filter that gets too full is refused by :meth:`insert`, which
    then returns False; the owner builds a larger one from its exact table."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int, load: float = 0.8) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, n / load / _SLOTS))))))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter with all of ``keys``, as small as takes them."""
        f = cls.sized(len(keys))
        while not f.insert(keys):
            f = cls(f.buckets * 2)
        return f

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(np.asarray(keys).view(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return (h & np.uint64(self.buckets - 1)).astype(np.int64), mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(mark.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _place(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets; returns which found none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        new = np.concatenate([[True], b[1:] != b[:-1]])
        rank = np.arange(len(b)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        slot = rank + (self.table[b] != 0).sum(1)  # full slots come first in a bucket
        fits = slot < _SLOTS
        self.table[b[fits], slot[fits]] = mark[order][fits]
        left = np.ones(len(b), bool)
        left[order[fits]] = False
        return left

    def insert(self, keys: np.ndarray, kicks: int = 500) -> bool:
        if not len(keys):
            return True
        before = self.table.copy()
        bucket, mark = self._marks(keys)
        left = self._place(bucket, mark)
        bucket, mark = self._other(bucket[left], mark[left]), mark[left]
        if len(mark):
            left = self._place(bucket, mark)
            bucket, mark = bucket[left], mark[left]
        for b, m in zip(bucket.tolist(), mark.tolist()):
            for k in range(kicks):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = m
                    break
                slot = (b * 31 + m + k) % _SLOTS
                m, self.table[b, slot] = int(self.table[b, slot]), m
                b = int(self._other(np.array([b]), np.array([m], np.uint16))[0])
            else:
                self.table = before
                return False
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        bucket, mark = self._marks(keys)
        return ((self.table[bucket] == mark[:, None]) | (self.table[self._other(bucket, mark)] == mark[:, None])).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one mark for each key, which must have been inserted."""
        bucket, mark = self._marks(keys)
        other = self._other(bucket, mark)
        for b1, b2, m in zip(bucket.tolist(), other.tolist(), mark.tolist()):
            for b in (b1, b2):
                at = np.flatnonzero(self.table[b] == m)
                if len(at):
                    last = int((self.table[b] != 0).sum()) - 1
                    self.table[b, at[0]], self.table[b, last] = self.table[b, last], 0
                    break

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        t = np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy()
        return cls(len(t), t)
