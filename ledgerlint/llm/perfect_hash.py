"""A minimal perfect hash of distinct 64-bit keys.

Level by level the keys left over are hashed into a bit array half as large
again; a key alone in its bit stays there, the others go to the next level. A
key's index is the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

from ledgerlint.llm.words import mix

ROOM = 1.5
STEP = 0x9E3779B97F4A7C15


def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seeded = keys.astype(np.uint64) + np.uint64(STEP * (level + 1) % 2 ** 64)
    return (mix(seeded) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Indexes 0..n-1 of n distinct keys; ``index`` of another key is -1 or
    anyone's, so callers compare the key stored there."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sums = [np.cumsum(bits, dtype=np.int64) for bits in levels]
        before = np.cumsum([0, *(int(s[-1]) for s in sums)])
        self.rank = [s - 1 + b for s, b in zip(sums, before)]
        self.size = int(before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = int(len(left) * ROOM) + 1
            at = slots(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = slots(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.rank[level][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *(len(b) for b in self.levels)], dtype="<i8")
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
        sizes = np.frombuffer(data, dtype="<i8", count=n, offset=8).tolist()
        levels, at = [], 8 * (n + 1)
        for size in sizes:
            packed = np.frombuffer(data, dtype=np.uint8, count=(size + 7) // 8, offset=at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels)
