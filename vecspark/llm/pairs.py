"""A hash table from pairs of ids to numbers, looked up a whole array at a time."""

from __future__ import annotations

import numpy as np

FREE = np.int64(-1)


class PairTable:
    """Finds the place of non-negative keys in the array given; -1 where absent.

    Open addressing with linear steps; the slots are at least ``spread`` times
    the keys, so most keys are settled by their first slot.
    """

    def __init__(self, keys: np.ndarray, spread: int = 8):
        self.bits = max(4, int(spread * max(1, len(keys)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, FREE)
        self.place = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(keys))
        slot = self._first(keys)
        while len(left):
            free = self.slots[slot] == FREE
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            one = one[free[one]]
            self.slots[slot[one]] = keys[left[one]]
            self.place[slot[one]] = left[one]
            rest = np.ones(len(left), dtype=bool)
            rest[one] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        slot = self._first(keys)
        held = self.slots[slot]
        out = np.where(held == keys, self.place[slot], -1)
        left = np.flatnonzero((held != keys) & (held != FREE))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.slots[slot[left]]
            match = held == keys[left]
            out[left[match]] = self.place[slot[left[match]]]
            left = left[~match & (held != FREE)]
        return out.reshape(shape)
