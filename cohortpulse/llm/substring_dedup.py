"""Substring dedup over words with fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``BLOCK`` words. A window of ``WINDOW`` words, wherever it
starts, covers a whole reference block of its own text, so an equal window elsewhere has that block among its rolling
runs of ``BLOCK`` words.

1. Every rolling run of every text probes the index of reference blocks; runs and blocks meet in shards of the hash space.
   A hit is a run that is a reference block somewhere and occurs more than once.
2. Hits are extended to both sides: of the windows that cover a hit, a lot sends each different one once, with its first
   place (smallest ``doc_id``, then start), to the shard of its fingerprint (80 bits), which tells the lots whose first
   place is not the first of all. There every occurrence is a repeat, elsewhere all but the first of the lot are.
   Neighbouring repeats add up to maximal ones.
3. Each document drops the words that its repeats cover.

Cases: a null or empty text has no words; a text of fewer than ``WINDOW`` words keeps all; a very long text closes its lot
and is treated whole; ties cannot occur, since a place is a ``doc_id`` and a start; rows with one ``doc_id`` are one
document, so that repeated rows do not remove each other; a null ``doc_id`` comes after all others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortpulse.llm.common import U64, documents, mixed
from cohortpulse.llm.exchange import answered, asked, by_lot, from_planes, lots, packed, planes, with_answers
from cohortpulse.llm.shingles import runs, word_hashes

WINDOW = 20
BLOCK = WINDOW // 2
#: Bits of a probe beside its shard, then two flags.
PROBE_BITS = 30
NO_ID = (1 << 63) - 1
_RESULT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, removed array<struct<start: long, words: long>>"
)


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(40)) % U64(shards)).astype(np.int64)


def _low(h: np.ndarray) -> np.ndarray:
    return h & U64((1 << PROBE_BITS) - 1)


def _probes(shards: int):
    """Sends each different run of a lot's texts to its shard: 30 bits, whether it is a reference block, whether the lot
    has it more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, _, _, texts in by_lot(batches):
            words, counts, *_ = word_hashes(texts, lower=False)
            h, first = runs(words, counts, BLOCK)
            if not len(h):
                continue
            offset = first - (np.cumsum(counts) - counts)[np.searchsorted(np.cumsum(counts), first, side="right")]
            shard = _shard_of(h, shards)
            value = (_low(h) << U64(2)) | (offset % BLOCK == 0).astype(U64)
            order = np.lexsort((value, shard))
            shard, value = shard[order], value[order]
            key = value >> U64(2)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])
            flags = np.bitwise_or.reduceat(value & U64(1), starts)
            many = (np.diff(np.r_[starts, len(value)]) > 1).astype(U64) << U64(1)
            entry = ((value[starts] & ~U64(3)) | flags | many).astype("<u4")
            shard = shard[starts]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            blobs = [planes(entry[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(shard)])]
            yield packed(shard[cuts].tolist(), [lot] * len(cuts), blobs)

    return run


def _hits(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Tells each lot which of its runs are reference blocks and occur more than once."""
    parts = [from_planes(blob, "<u4") for _, blob in held]
    everything = np.sort(np.concatenate(parts))
    key = everything >> np.uint32(2)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    flags = np.bitwise_or.reduceat(everything & np.uint32(3), starts)
    often = (np.diff(np.r_[starts, len(key)]) > 1) | (flags & np.uint32(2) > 0)
    hit = key[starts][often & (flags & np.uint32(1) > 0)]
    if not len(hit):
        return
    for (lot, _), part in zip(held, parts):
        own = part >> np.uint32(2)
        place = np.minimum(np.searchsorted(hit, own), len(hit) - 1)
        found = own[hit[place] == own]
        if len(found):
            yield lot, found.astype("<u4").tobytes()


def _windows(shards: int):
    """Extends hits: sends the fingerprint of each window that covers one, with its document and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, answers, ids, texts in by_lot(batches):
            if not answers:
                continue
            words, counts, *_ = word_hashes(texts, lower=False)
            h, first = runs(words, counts, BLOCK)
            hit = np.unique(np.frombuffer(answers, "<u4")).astype(U64)
            low = _low(h)
            place = np.minimum(np.searchsorted(hit, low), len(hit) - 1)
            at = first[hit[place] == low]
            edges = np.zeros(len(words) + 1, np.int32)
            np.add.at(edges, np.maximum(at - (WINDOW - BLOCK), 0), 1)
            np.add.at(edges, at + 1, -1)
            near = np.cumsum(edges[:-1]) > 0
            full, start = runs(words, counts, WINDOW)
            keep = near[start]  # a window of the text before may be marked too; its fingerprint decides
            full, start = full[keep], start[keep]
            if not len(full):
                continue
            _, doc, offset = _places(ids, counts, start)
            extra = _second(words, start)
            order = np.lexsort((offset, doc, extra, full))
            first_of_lot = order[_opens(full[order], extra[order])]
            shard = _shard_of(full[first_of_lot], shards)
            by_shard = np.argsort(shard, kind="stable")
            shard, sent = shard[by_shard], first_of_lot[by_shard]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            blobs = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(shard)]):
                part = sent[a:b]
                columns = (full[part].astype("<u8"), extra[part], doc[part].astype("<i8"), offset[part].astype("<u4"))
                blobs.append(b"".join(map(planes, columns)))
            yield packed(shard[cuts].tolist(), [lot] * len(cuts), blobs)

    return run


def _places(ids: list[int | None], counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, ``doc_id`` and offset in its text of the words at ``start``."""
    owner = np.searchsorted(np.cumsum(counts), start, side="right")
    doc = np.array([NO_ID if i is None else i for i in ids], np.int64)[owner]
    return owner, doc, start - (np.cumsum(counts) - counts)[owner]


def _opens(full: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Where sorted fingerprints change."""
    return np.r_[True, (full[1:] != full[:-1]) | (extra[1:] != extra[:-1])] if len(full) else np.zeros(0, bool)


def _second(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sixteen more bits of the fingerprint of the windows at ``start``, from other arithmetic."""
    out = np.zeros(len(start), U64)
    for k in range(WINDOW):
        out = out * U64(0xD1342543DE82EF95) + (words[start + k] ^ (words[start + k] >> U64(29)))
    return (mixed(out) >> U64(48)).astype("<u2")


def _later(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Tells each lot which of its windows occur before its own first place."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for k, (_, blob) in enumerate(held):
        n = len(blob) // 22
        ends = np.cumsum([0, 8 * n, 2 * n, 8 * n, 4 * n])
        for column, kind, a, b in zip(columns, ("<u8", "<u2", "<i8", "<u4"), ends[:-1], ends[1:]):
            column.append(from_planes(blob[a:b], kind))
        columns[4].append(np.full(n, k, np.int32))
    full, extra, doc, start, lot = map(np.concatenate, columns)
    order = np.lexsort((start, doc, extra, full))
    full, extra, doc, start, lot = (c[order] for c in (full, extra, doc, start, lot))
    new = _opens(full, extra)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero((doc != doc[first]) | (start != start[first]))
    later = later[np.argsort(lot[later], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, lot[later][1:] != lot[later][:-1]]) if len(later) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(later)].astype(int) if len(later) else []):
        part = later[a:b]
        told = np.empty(len(part), _TOLD)
        told["full"], told["extra"] = full[part], extra[part]
        yield held[lot[part[0]]][0], told.tobytes()


_TOLD = np.dtype([("full", "<u8"), ("extra", "<u2")])


def _repeats(ids: list[int | None], texts: list[bytes], told: np.ndarray) -> list[np.ndarray]:
    """Starts of the windows of each text that occur earlier: those ``told``, and all but the first of the lot."""
    words, counts, *_ = word_hashes(texts, lower=False)
    full, start = runs(words, counts, WINDOW)
    order = np.argsort(full, kind="stable")
    same = full[order][1:] == full[order][:-1]
    often = np.r_[same, False] | np.r_[False, same] if len(full) else np.zeros(0, bool)
    near = np.zeros(len(full), bool)
    near[order] = often | np.isin(full[order], told["full"])
    full, start = full[near], start[near]
    owner, doc, offset = _places(ids, counts, start)
    n = len(told)
    full, extra = np.r_[told["full"], full], np.r_[told["extra"], _second(words, start)]
    own = np.arange(len(full)) >= n  # what was told comes before the lot's own windows
    owner, doc, offset = (np.r_[np.full(n, -1), c] for c in (owner, doc, offset))
    order = np.lexsort((offset, doc, own, extra, full))
    full, extra, own, owner, doc, offset = (c[order] for c in (full, extra, own, owner, doc, offset))
    new = _opens(full, extra)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = own & (~own[first] | (doc != doc[first]) | (offset != offset[first]))
    owner, offset = owner[later], offset[later]
    order = np.lexsort((offset, owner))
    return np.split(offset[order], np.searchsorted(owner[order], np.arange(1, len(texts))))


def _reduced(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, answers, ids, texts in by_lot(batches):
            out = []
            for doc_id, text, starts in zip(ids, texts, _repeats(ids, texts, np.frombuffer(answers, _TOLD))):
                words = text.split()
                gone = _covered(starts)
                for a, b in reversed(gone):
                    del words[a:b]
                kept = b" ".join(words)
                removed = sum(b - a for a, b in gone)
                out.append(
                    {
                        "doc_id": doc_id, "n_words": len(words) + removed, "n_removed": removed,
                        "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode() if with_text else None,
                        "removed": [{"start": a, "words": b - a} for a, b in gone],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return run


def _covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of words covered by the windows at ``starts``."""
    out: list[tuple[int, int]] = []
    for s in starts.tolist():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + WINDOW)
        else:
            out.append((s, s + WINDOW))
    return out


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
        ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))),
    ]
)


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): the words that stay, their hash and the runs that went."""
    base, shards = lots(docs)
    hits = answered(asked(base, None, _probes(shards)), _hits, "repeat-hits")
    later = answered(asked(base, hits, _windows(shards)), _later, "repeat-later")
    return with_answers(base, later, _reduced(with_text), _RESULT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), with_text=False).drop("kept", "removed")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), w AS (
  SELECT row, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place,
    unnest([array_to_string(words[i : i + 19], ' ') FOR i IN range(1, len(words) + 1)]) AS follow, len(words) AS n
  FROM d
), later AS (
  SELECT row, place FROM (
    SELECT row, place, rank() OVER (PARTITION BY follow ORDER BY doc_id, place) AS nth FROM w WHERE place + 19 <= n
  ) WHERE nth > 1
), k AS (
  SELECT w.row, word, w.place,
    coalesce(max(later.place) OVER (PARTITION BY w.row ORDER BY w.place) >= w.place - 19, FALSE) AS removed
  FROM w LEFT JOIN later ON w.row = later.row AND w.place = later.place
)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (removed) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT removed), '')) AS kept_sha256
FROM d LEFT JOIN k ON d.row = k.row GROUP BY d.row, d.doc_id
"""
