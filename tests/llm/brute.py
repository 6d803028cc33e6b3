"""Plain versions of operators that SQL cannot express."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = WORD.findall((text or "").translate(_LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_groups(rows):
    """``{id: (shingles, component, kept)}`` of ``(id, text)``."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, own in sorted(sets.items()):
        common = Counter(j for x in own for j in holders[x])
        for x in own:
            holders[x].append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(own) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(own), find(i), find(i) == i) for i, own in sets.items()}


def without_windows(rows, size=20):
    """``{id: (words, removed, sha256)}``: words covered by a window that starts earlier elsewhere are removed."""
    words = {i: [w.encode() for w in WORD.findall(t or "")] for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][s : s + size]), (i, s))
    out = {}
    for i, own in words.items():
        gone = set()
        for s in range(len(own) - size + 1):
            if first[tuple(own[s : s + size])] != (i, s):
                gone.update(range(s, s + size))
        kept = b" ".join(w for k, w in enumerate(own) if k not in gone)
        out[i] = (len(own), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def without_strings(texts, size=400):
    """``[(bytes, removed, spans, sha256)]``: bytes covered by a string that also starts elsewhere are removed."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[s : s + size] for x in data for s in range(len(x) - size + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for s in range(len(x) - size + 1):
            if seen[x[s : s + size]] > 1:
                gone[s : s + size] = b"\x01" * size
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
