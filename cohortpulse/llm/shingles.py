"""Hashes of words and of runs of words, on arrays of bytes."""

from __future__ import annotations

import numpy as np

from cohortpulse.llm.common import U64, mixed

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mixed(np.arange(1, 257, dtype=U64))
_STEP = U64(0x9E3779B97F4A7C15)


def _powers(base: U64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """A hash of each word of all texts, the number of words of each text, and where words begin and end in the texts
    joined by line ends. ``lower`` folds A-Z."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = ends - starts
    text_starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    counts = np.diff(np.searchsorted(starts, text_starts))
    if not len(starts):
        return np.zeros(0, U64), counts, starts, ends, joined
    letters = data[inside]
    if lower:
        letters = _LOWER[letters]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    terms = _BYTE[letters] * _powers(_STEP, int(lengths.max()))[place]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(U64)), counts, starts, ends, joined


def runs(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every ``size`` words in a row of each text, and the first word of each run."""
    ends = np.cumsum(counts)
    fits = np.maximum(counts - size + 1, 0)
    first = np.repeat(ends - counts, fits) + (np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits))
    out = np.full(len(first), size, U64)
    for k in range(size):
        out = mixed(out * _STEP + words[first + k]) if k % 4 == 3 or k == size - 1 else out * _STEP + words[first + k]
    return out, first


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another, and their number.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    words, counts, _, _, _ = word_hashes(texts, lower=True)
    hashes, first = runs(words, counts, size)
    owner = np.searchsorted(np.cumsum(counts), first, side="right")
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.empty(len(short), U64)
        for i, t in enumerate(short):
            h = np.full(1, 1000 + counts[t], U64)
            for w in words[ends[t] - counts[t] : ends[t]]:
                h = mixed(h * _STEP + w)
            extra[i] = h[0]
        hashes, owner = np.r_[hashes, extra], np.r_[owner, short]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))
