"""Hash tables whose keys and values are numpy arrays: many keys are looked up or added at once."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """64-bit keys (not zero) to integers, by open addressing. Holds twice as many slots as keys at least."""

    def __init__(self, bits: int = 12):
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.shift, self.n = bits, np.uint64(64 - bits), 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.vals[slot], default)
        at = np.flatnonzero((there != keys) & (there != 0))
        if len(at):
            slot, keys = slot[at], keys[at]
            while len(at):
                slot = (slot + 1) & (len(self.keys) - 1)
                there = self.keys[slot]
                hit = there == keys
                out[at[hit]] = self.vals[slot[hit]]
                go = ~hit & (there != 0)
                at, slot, keys = at[go], slot[go], keys[go]
        return out

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Adds keys, all different, that aren't in the table."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            live = self.keys != 0
            old_keys, old_vals = self.keys[live], self.vals[live]
            self._make(int(4 * (self.n + len(keys))).bit_length())
            self.add(old_keys, old_vals)
        self.n += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last stays
            done = self.keys[slot] == keys
            self.vals[slot[done]] = vals[done]
            rest = ~done
            slot, keys, vals = (slot[rest] + 1) & (len(self.keys) - 1), keys[rest], vals[rest]
