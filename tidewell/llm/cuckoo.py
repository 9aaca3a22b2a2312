"""A cuckoo filter over 64-bit hashes: four 16-bit fingerprints a bucket, insertion, deletion, vectorised look-up."""

from __future__ import annotations

import numpy as np

SLOTS, MAX_LOAD, MAX_KICKS = 4, 0.85, 500


def buckets_for(n: int) -> int:
    """The least power of two of buckets that holds n keys at the greatest load."""
    out = 1
    while out * SLOTS * MAX_LOAD < n:
        out *= 2
    return out


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS) uint16; 0: free
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        n = buckets_for(len(hashes))
        while True:
            out = cls(np.zeros((n, SLOTS), np.uint16))
            if all(out.insert(h) for h in hashes.tolist()):
                return out
            n *= 2

    def _places(self, h: np.ndarray):
        h = h.astype(np.uint64)
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        first = h & self.mask
        second = first ^ (fp.astype(np.uint64) * np.uint64(0x5BD1E995) & self.mask)
        return fp, first.astype(np.int64), second.astype(np.int64)

    def __contains__(self, h: int) -> bool:
        return bool(self.contains(np.array([h], np.uint64))[0])

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(hashes)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def insert(self, h: int) -> bool:
        """False if no place was found: the filter is as before, and is to be built anew."""
        fps, firsts, seconds = self._places(np.array([h], np.uint64))
        fp, at, mask = int(fps[0]), int(firsts[0]), int(self.mask)
        for place in (at, int(seconds[0])):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = fp
                return True
        moved = []
        for kick in range(MAX_KICKS):
            slot = (fp + kick) % SLOTS
            moved.append((at, slot, int(self.table[at, slot])))
            fp, self.table[at, slot] = int(self.table[at, slot]), fp
            at ^= fp * 0x5BD1E995 & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return True
        for at, slot, held in reversed(moved):
            self.table[at, slot] = held
        return False

    def delete(self, h: int) -> bool:
        fps, firsts, seconds = self._places(np.array([h], np.uint64))
        for place in (int(firsts[0]), int(seconds[0])):
            held = np.flatnonzero(self.table[place] == fps[0])
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False
