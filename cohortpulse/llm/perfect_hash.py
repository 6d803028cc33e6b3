"""Minimal perfect hashing of 128-bit digests on arrays.

``n`` different digests get the places 0 to n-1. A level is a bit array about ``SPREAD`` times as long as the digests that
reach it; those that meet no other at their bit take it, the others go on to the next level. The place of a digest is the
number of set bits before its own, over all levels: about three bits a digest, and no digest is stored.
"""

from __future__ import annotations

import numpy as np

from cohortpulse.llm.common import U64, mixed

#: Bits of a level for each digest that reaches it.
SPREAD = 1.5
_SEED = U64(0x9E3779B97F4A7C15)


def _bit(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """Both halves count, so that digests with one half in common part at some level."""
    with np.errstate(over="ignore"):
        seed = U64(2 * level + 1) * _SEED
        return (mixed(mixed(high + seed) ^ (low * (seed | U64(1)))) % U64(size)).astype(np.int64)


def built(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """The levels, as arrays of 0 and 1. Digests are pairs of 64-bit halves and must differ."""
    levels = []
    while len(high):
        size = int(len(high) * SPREAD) + 8
        at = _bit(high, low, len(levels), size)
        level = np.bincount(at, minlength=size) == 1
        levels.append(level.astype(np.uint8))
        rest = ~level[at]
        high, low = high[rest], low[rest]
    return levels


class Places:
    """``places.of(high, low)``: the place of every digest that was built in, some place or -1 for any other."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        starts = np.cumsum([0, *(int(x.sum(dtype=np.int64)) for x in levels)])
        self.size = int(starts[-1])
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 + s for x, s in zip(levels, starts)]

    def of(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), -1, np.int64)
        rest = np.arange(len(high))
        for k, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _bit(high[rest], low[rest], k, len(level))
            found = level[at] == 1
            out[rest[found]] = rank[at[found]]
            rest = rest[~found]
        return out


def to_bytes(levels: list[np.ndarray]) -> tuple[bytes, bytes]:
    """The lengths of the levels and their bits, eight to a byte."""
    sizes = np.array([len(x) for x in levels], "<i8").tobytes()
    return sizes, b"".join(np.packbits(x).tobytes() for x in levels)


def from_bytes(sizes: bytes, bits: bytes) -> list[np.ndarray]:
    levels, start, packed = [], 0, np.frombuffer(bits, np.uint8)
    for size in np.frombuffer(sizes, "<i8").tolist():
        end = start + -(-size // 8)
        levels.append(np.unpackbits(packed[start:end], count=size))
        start = end
    return levels
