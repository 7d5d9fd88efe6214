"""Minimal perfect hash of byte strings, with the strings stored by slot so that strangers are told apart.

Levels of bits: a key whose place in a level no other key shares gets the place's rank as its slot; the others go on to
the next level. Keys left after LEVELS levels (as good as none, but for equal 64-bit hashes) are kept in a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .anchors import mix

ROOM, LEVELS, SEED = 1.7, 32, 42


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same numbers as Spark's ``xxhash64``."""
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, words: list[bytes]):
        """``words`` must differ from each other."""
        h, slots = hashes(words), np.empty(len(words), np.int64)
        self.levels, left, base = [], np.arange(len(words)), 0
        while len(left) and len(self.levels) < LEVELS:
            size = -(-max(64, int(ROOM * len(left))) // 64) * 64
            place = _places(h[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            rank = base + np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]]
            self.levels.append((size, bits, rank))
            mine = alone[place]
            slots[left[mine]] = self._ranked(place[mine], bits, rank)
            base += int(alone.sum())
            left = left[~mine]
        slots[left] = base + np.arange(len(left))
        self.rest = {words[i]: int(slots[i]) for i in left}
        order = np.argsort(slots)
        self.keys = pa.array([words[i] for i in order], pa.large_binary())

    @staticmethod
    def _ranked(place: np.ndarray, bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return rank[word] + np.bitwise_count(below)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, words: pa.Array, h: np.ndarray) -> np.ndarray:
        """Slot of each word, -1 for words that are not stored; ``h`` are their hashes."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (size, bits, rank) in enumerate(self.levels):
            place = _places(h[left], level, size)
            hit = (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._ranked(place[hit], bits, rank)
            left = left[~hit]
            if not len(left):
                break
        if self.rest:
            for i in left:
                out[i] = self.rest.get(words[int(i)].as_py(), -1)
        asked = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[asked])), words.take(pa.array(asked)))
        out[asked[~same.to_numpy(zero_copy_only=False)]] = -1
        return out
