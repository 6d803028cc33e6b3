"""Words of texts as integer codes, and hashed character n-grams of the different words, on arrays."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd

from cohortpulse.llm.common import U64, mixed

_LETTERS = re.compile(r"[^\W\d_]+")


def coded_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different lower-case words, the code of every word, and the number of words of each text.

    A word is a run of letters. Null has none.
    """
    found = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), object, int(counts.sum()))
    codes, different = pd.factorize(flat)
    return list(different), codes.astype(np.int64), counts


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and the length of each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.fromiter(map(len, words), np.int64, len(words))


def ngram_buckets(words: list[str], sizes: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the buckets of all n-grams and the index of their words. Words are framed by boundary marks."""
    points, _ = code_points([f"\x02{w}\x03" for w in words])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    out = []
    for n in sizes:
        if len(points) < n:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        within = np.flatnonzero(owner[: len(points) - n + 1] == owner[n - 1 :])
        h = np.full(len(within), n, U64)
        for k in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + points[within + k]
        out.append(((mixed(h) % U64(buckets)).astype(np.int64), owner[within]))
    return out
