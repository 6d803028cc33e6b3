"""License statements found by conditional compression.

Lines that use the vocabulary of licenses, with the lines between them, are candidate blocks. A notice that is wrapped may
begin and end on lines without that vocabulary, so ``OVERLAP`` words before and after a block are read with it. A statement
belongs to the first block that it touches; words broken after a hyphen at a line's end are joined. Each block is compressed with
Zstandard alone and with each template as raw dictionary. What a template saves, as a share of what it saves on its own
wording, picks and ranks the templates: below ``LEAST_SHARE`` a template is out, whatever words the block holds. The others are
confirmed word by word. The block must hold nearly all words of the template in order; a word that tells versions apart (one
with a digit) may not be missing, one that tells licenses apart (``NAMES``, ``PAIRS``) neither missing nor inserted. The
differences are returned. Licenses that are not in ``TEMPLATES`` are not reported.

The template with the fewest differences claims its words of the block, then the one with the larger share, then the longer one.

Cases: a null or empty text has no statement; a text may have several; repeated rows are reported alike; long lines are
read whole, in overlapping stretches; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import documents

# Wording of public licenses and of the notices by which texts refer to them, by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    (
        "CC-BY-NC-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    (
        "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    (
        "LGPL-2.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
        "your option) any later version.",
    ),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Words, or parts of words with hyphens, by which licenses of like wording differ, alone or after another.
NAMES = frozenset("affero lesser apache mozilla noncommercial sharealike noderivatives noderivs nc sa nd".split())
PAIRS = frozenset(
    [("gnu", "library"), ("non", "commercial"), ("share", "alike"), ("no", "derivatives"), ("no", "derivs")]
)
# What a license statement mentions; two words of a hint may stand on two lines.
HINT = r"(?i)licen[cs]e|copyright|permission|permitted|warrant|redistribut|public\W+domain|creative\W+commons|cc0|cc\W+by"

#: Lines without a hint that may lie between two of one block.
GAP = 4
#: Words compared at a time, and how far stretches overlap (more than the longest template).
STRETCH, OVERLAP = 400, 120
#: Share of a template's words that must stand in the block, in order.
LEAST_WORDS = 0.9
#: Share of a template's saving on its own wording that it must save on the block or on a window of it.
LEAST_SHARE = 0.05
#: Words of a window.
WINDOW = 24
_WORDS = re.compile(r"\w+(?:[-.]\w+)*")
_HINT = re.compile(HINT)
_BROKEN = re.compile(r"\w-\s*$")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Template(NamedTuple):
    license: str
    words: list[str]
    compressor: zstandard.ZstdCompressor
    own: int  #: bytes it saves on its own wording


@cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@cache
def _templates() -> list[Template]:
    out = []
    for name, text in TEMPLATES:
        raw = " ".join(words_of(text)).encode()
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
        own = len(_plain().compress(raw)) - len(compressor.compress(raw))
        out.append(Template(name, words_of(text), compressor, own))
    return out


def _saved(words: list[str], template: Template) -> tuple[float, float]:
    """What the template saves on ``words``: as a share of its own saving, and of the words compressed alone."""
    raw = " ".join(words).encode()
    alone = len(_plain().compress(raw))
    saved = alone - len(template.compressor.compress(raw))
    return saved / max(template.own, 1), saved / alone


def ranked(words: list[str]) -> list[tuple[float, float, int]]:
    """``(share, saving, template)`` of the templates that save enough on ``words``, best first.

    In much text that shares words with it, a short statement saves little; a template below the floor is tried on
    overlapping windows of ``WINDOW`` words, or of twice its length, and has the best of their shares.
    """
    often = Counter(words)
    out = []
    for k, template in enumerate(_templates()):
        own = template.words
        if (Counter(own) & often).total() < LEAST_WORDS * len(own):
            continue  # cannot be confirmed
        share, saving = _saved(words, template)
        if share < LEAST_SHARE:
            wide = max(WINDOW, 2 * len(own))
            windows = (words[i : i + wide] for i in range(0, max(1, len(words) - wide // 2), wide // 2))
            share, saving = max(_saved(w, template) for w in windows)
        if share >= LEAST_SHARE:
            out.append((share, saving, k))
    return sorted(out, key=lambda r: (-r[0], -len(_templates()[r[2]].words), r[2]))


class Block(NamedTuple):
    first: int
    last: int
    before: int  #: last line of the block before, or -1
    words: list[str]  #: of the block and around it
    lines: list[int]  #: where each word stands
    core: tuple[int, int]  #: the words of the block itself

    def parts(self) -> list[tuple[int, int]]:
        """Ranges of words to compare: the block, and its beginning and end with what lies around."""
        (a, b), n, inside = self.core, len(self.words), STRETCH - OVERLAP
        return list(dict.fromkeys([(a, b), (0, min(n, a + inside)), (max(0, b - inside), n)]))

    def owns(self, first: int, last: int) -> bool:
        """Whether a statement from word ``first`` to word ``last`` touches this block and none before."""
        return self.before < self.lines[first] <= self.last and self.lines[last] >= self.first


def _hinted(text: str) -> list[int]:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    found: set[int] = set()
    for m in _HINT.finditer(text):
        found.update(range(bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1)))
    return sorted(found)


def blocks(text: str) -> Iterator[Block]:
    """Each run of hinted lines, gaps of up to ``GAP`` lines included."""
    hinted = _hinted(text)
    if not hinted:
        return
    lines = text.split("\n")
    line_words = cache(lambda i: words_of(lines[i]))
    start, before = 0, -1
    for k, i in enumerate(hinted):
        if k + 1 < len(hinted) and hinted[k + 1] - i <= GAP + 1:
            continue
        held = [(w, j) for j in range(hinted[start], i + 1) for w in line_words(j)]
        head: list[tuple[str, int]] = []
        tail: list[tuple[str, int]] = []
        j = hinted[start]
        while j and len(head) < OVERLAP:
            j -= 1
            head = [(w, j) for w in line_words(j)[-OVERLAP:]] + head
        j = i + 1
        while j < len(lines) and len(tail) < OVERLAP:
            tail += [(w, j) for w in line_words(j)[:OVERLAP]]
            j += 1
        words: list[str] = []
        at: list[int] = []
        core, came = [0, 0], i
        for part, own in ((head, 0), (held, 1), (tail, 0)):
            if own:
                core[0] = len(words)
            for w, j in part:
                if words and came < j and _BROKEN.search(lines[came]):
                    words[-1] += f"-{w}"
                else:
                    words.append(w)
                    at.append(j)
                came = j
            if own:
                core[1] = len(words)
        yield Block(hinted[start], i, before, words, at, (core[0], core[1]))
        start, before = k + 1, i


def stretches(first: int, end: int) -> Iterator[tuple[int, int]]:
    for i in range(first, max(first + 1, end - OVERLAP), STRETCH - OVERLAP):
        yield i, min(i + STRETCH, end)


def _names(words: list[str], i: int) -> bool:
    """Whether the word at ``i`` tells licenses apart; so does any kind of attribution."""
    own = words[i].split("-")
    parts = [*words[i - 1].split("-")[-1:], *own] if i else own
    return bool(NAMES.intersection(own) or PAIRS.intersection(zip(parts, parts[1:]))) or own[0] == "attribution" != words[i]


def _differences(template: list[str], words: list[str]) -> tuple[list[str], list[str], set[int], bool] | None:
    """Words of the template that ``words`` lacks, words inserted between them, where the template's words stand, and
    whether the differences make it another license; None if too few are there."""
    matches = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    while sum(m.size for m in matches) >= LEAST_WORDS * len(template):
        held = {i for m in matches for i in range(m.a, m.a + m.size)}
        used = {i for m in matches for i in range(m.b, m.b + m.size)}
        missing = [i for i in range(len(template)) if i not in held]
        added = [i for i in range(matches[0].b, matches[-1].b + matches[-1].size) if i not in used]
        if len(added) <= len(template):
            other = any(any(map(str.isdigit, template[i])) or _names(template, i) for i in missing)
            other = other or any(_names(words, i) for i in added)
            return [template[i] for i in missing], [words[i] for i in added], used, other
        # a common word far from the others is not part of the statement
        gaps = [matches[k + 1].b - matches[k].b - matches[k].size for k in (0, -2)]
        matches.pop(0 if gaps[0] >= gaps[1] else -1)
    return None


def _found(
    template: list[str], words: list[str], owns: Callable[[int, int], bool]
) -> tuple[list[str], list[str], set[int]] | None:
    """The differences of the template's statement in ``words``; the words around one that is another license, or another
    block's, are searched for it too."""
    wanted, least = Counter(template), LEAST_WORDS * len(template)
    open_ranges = [(0, len(words))]
    while open_ranges:
        a, b = open_ranges.pop()
        if (wanted & Counter(words[a:b])).total() < least:
            continue
        block = SequenceMatcher(None, template, words[a:b], autojunk=False).find_longest_match()
        start = a + block.b - block.a
        options = []
        for around in (len(template), len(template) // 10):  # words alike in a neighbouring statement may lead astray
            lo, hi = max(a, start - around), min(b, start + len(template) + around)
            if found := _differences(template, words[lo:hi]):
                missing, added, used, other = found
                options.append((missing, added, {lo + i for i in used}, other))
        first, last = a + block.b, a + block.b + block.size - 1
        if options:
            missing, added, used, other = min(options, key=lambda o: len(o[0]) + len(o[1]))
            first, last = min(used), max(used)
            if not other and owns(first, last):
                return missing, added, used
        open_ranges += [(last + 1, b), (a, first)]
    return None


def statements(text: str | None) -> Iterator[dict]:
    """Every license stated in ``text``: its first line, its name, the saving and the differences in wording."""
    for block in blocks(text or ""):
        confirmed = []
        for a, b in dict.fromkeys(s for part in block.parts() for s in stretches(*part)):
            words = block.words[a:b]
            for share, saving, k in ranked(words):
                name, template, *_ = _templates()[k]
                if found := _found(template, words, lambda i, j: block.owns(a + i, a + j)):
                    missing, added, used = found
                    used = {a + i for i in used}
                    differences = len(missing) + len(added)
                    confirmed.append((differences, -share, -len(template), k, saving, name, missing, added, used))
        seen: dict[str, dict] = {}
        claimed: set[int] = set()
        for *_, saving, name, missing, added, used in sorted(confirmed, key=lambda c: c[:4]):
            if 2 * len(used & claimed) > len(used):
                continue  # these words already are another statement, with fewer differences
            claimed |= used
            if name not in seen:  # the one with the fewest differences comes first
                first = min(block.first, block.lines[min(used)])
                seen[name] = {
                    "first_line": first, "lines": max(block.last, block.lines[max(used)]) - first + 1, "license": name,
                    "saving": saving, "missing": missing, "added": added, "exact": not missing and not added,
                }
        yield from seen.values()


_FOUND = (
    "doc_id long, first_line int, lines int, license string, saving double, missing array<string>, added array<string>,"
    " exact boolean"
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("first_line", pa.int32()), ("lines", pa.int32()), ("license", pa.string()),
            ("saving", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())),
            ("exact", pa.bool_()),
        ]
    )
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        rows = [{"doc_id": i, **s} for i, t in zip(ids, texts) for s in statements(t)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def scan(docs: DataFrame) -> DataFrame:
    """One row per license stated in a block of a text of ``docs`` (``doc_id``, ``text``)."""
    hinted = docs.where(F.col("text").rlike(HINT))
    return hinted.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run, _FOUND)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
