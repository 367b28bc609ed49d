"""A cuckoo filter in numpy: approximate set membership with deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4


class Full(Exception):
    """No free slot was found; the filter must be built anew with more buckets."""


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Holds 16-bit fingerprints of 64-bit keys, four to a bucket; each key has two possible buckets.

    Each key may be inserted once (the reference-count table behind the filter sees to that). No false negatives; about
    8 / 65536 false positives. buckets is a power of two.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> "CuckooFilter":
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8)))))

    @classmethod
    def loads(cls, blob: bytes) -> "CuckooFilter":
        t = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(t), t)

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = _spread(np.asarray(keys).astype(np.uint64))
            fp = (h >> np.uint64(48)).astype(np.uint16)
            fp[fp == 0] = 1
            one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return fp, one, self._other(one, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return bucket ^ (_spread(fp.astype(np.uint64) + np.uint64(1)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        fp, one, two = self._places(keys)
        return (self.table[one] == fp[:, None]).any(1) | (self.table[two] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray, max_kicks: int = 500) -> None:
        """Places whole arrays at once, one key per bucket and round; keys without a free slot push others out."""
        fp, at, _ = self._places(keys)
        rng = np.random.default_rng(len(fp))
        for k in range(max_kicks):
            if not len(fp):
                return
            _, first = np.unique(at, return_index=True)
            rest = np.ones(len(fp), bool)
            rest[first] = False
            b, f = at[first], fp[first]
            free = self.table[b] == 0
            has = free.any(1)
            slot = np.where(has, free.argmax(1), rng.integers(0, SLOTS, len(b)))
            if k == 0:  # a full first bucket: try the other bucket before pushing anything out
                self.table[b[has], slot[has]] = f[has]
                out_fp, out_at = f[~has], self._other(b[~has], f[~has])
            else:
                old = self.table[b, slot].copy()
                self.table[b, slot] = f
                out_fp, out_at = old[~has], self._other(b[~has], old[~has])
            fp, at = np.concatenate([fp[rest], out_fp]), np.concatenate([at[rest], out_at])
        if len(fp):
            raise Full(len(fp))

    def delete(self, keys: np.ndarray) -> None:
        """Removes one copy of each key's fingerprint; the keys must have been inserted."""
        fp, one, two = self._places(keys)
        for f, a, b in zip(fp.tolist(), one.tolist(), two.tolist()):
            for x in (a, b):
                s = np.flatnonzero(self.table[x] == f)
                if len(s):
                    self.table[x, s[0]] = 0
                    break
