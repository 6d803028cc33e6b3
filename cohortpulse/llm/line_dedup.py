"""Line dedup: a sharded minimal perfect hash over line digests, probed by documents.

Documents are written once in compressed lots. A task turns its lots into entries ``digest, documents, largest id``, one
for each different line of a few hundred thousand, and sends them to the shards of the digest space; a line that stands in
every document is one entry for each such batch. A shard adds the entries up and builds its index over the different lines
found in at least ``least`` documents: the levels of a minimal perfect hash and, at the place of each line, a 64-bit
fingerprint, the number of documents and the largest ``doc_id``. The index is a table of arrays, written; no line is stored
in it. Then each lot sends the digests of its different lines, 16 bytes each, to the shards, which look them up in the
arrays; the fingerprint turns lines away that were not built in. A lot gets back the repeated lines only. Place and
fingerprint come from the 128 bits of XXH3 of the key.

A line is what stands between ``\\n``; its key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of
at least ``points`` code points found in at least ``least`` documents lose their lines except in the largest ``doc_id``.

Cases: a null or empty text is one empty line, which is too short to go; every row is a document, so repeated rows count
each, and rows that share the largest id all keep the line (ties); a null ``doc_id`` counts as smaller than any other; a
very long text is a lot of its own, its lines are never cut; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm import perfect_hash
from cohortpulse.llm.common import SPACES, U64, documents, shuffle_partitions
from cohortpulse.llm.exchange import by_lot, lots, with_answers
from cohortpulse.sources.scratch import written

POINTS, LEAST = 20, 3
#: Entries that a task adds up before it sends them, or a shard before it adds them up.
HELD_ENTRIES = 400_000
#: Bytes of text whose lines one shard holds.
SHARD_BYTES = 64_000_000
#: Stands for a null id, below all others.
_NO_ID = -(1 << 63)

_SPACES = SPACES.encode()
_DIGEST = np.dtype([("high", "<u8"), ("low", "<u8")])
_ENTRY = np.dtype([("high", "<u8"), ("low", "<u8"), ("docs", "<i8"), ("largest", "<i8")])
_INDEX = ("sizes", "bits", "fingerprints", "counts", "largest")
_INDEX_SCHEMA = "shard int, lines long, " + ", ".join(f"{c} binary" for c in _INDEX)
_KEPT_SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_text string"
_SENT = pa.schema([("shard", pa.int32()), ("lot", pa.int64()), ("asked", pa.binary())])


def _digest(line: bytes, points: int) -> bytes | None:
    """The digest of the key of a line, None where the key is too short."""
    key = line.strip(_SPACES).lower()
    if len(key) < points or (len(key) < 4 * points and not key.isascii() and len(key.decode()) < points):
        return None
    return xxhash.xxh3_128_digest(key)


def _line_digests(text: bytes, points: int) -> set[bytes]:
    found = {_digest(line, points) for line in text.split(b"\n")}
    found.discard(None)
    return found


def _added(entries: np.ndarray) -> np.ndarray:
    """One entry for each digest, in their order: documents added up, the largest id."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort([entries["low"], entries["high"]])]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["high"][1:] != entries["high"][:-1]) | (entries["low"][1:] != entries["low"][:-1])
    starts = np.flatnonzero(new)
    out = entries[starts]
    out["docs"] = np.add.reduceat(entries["docs"], starts)
    out["largest"] = np.maximum.reduceat(entries["largest"], starts)
    return out


def _by_shard(entries: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ranges of sorted digests: the shard is the digest's place among ``shards`` equal parts of the space."""
    part = ((entries["high"] >> U64(33)) * U64(shards)) >> U64(31)
    edges = np.searchsorted(part, np.arange(shards + 1, dtype=U64))
    for shard in np.flatnonzero(np.diff(edges)):
        yield int(shard), entries[edges[shard] : edges[shard + 1]]


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, lot, asked = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), pa.array(lot, pa.int64()), pa.array(asked, pa.binary())], schema=_SENT
    )


def _entries(shards: int, points: int):
    """Entries of a task's documents, added up over many lots before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def sent() -> pa.RecordBatch:
            return _sent([(s, 0, part.tobytes()) for s, part in _by_shard(_added(np.concatenate(held)), shards)])

        for _, _, ids, texts in by_lot(batches):
            for doc_id, text in zip(ids, texts):
                own = _line_digests(text, points)
                if not own:
                    continue
                entries = np.zeros(len(own), _ENTRY)
                digests = np.frombuffer(b"".join(own), _DIGEST)
                entries["high"], entries["low"] = digests["high"], digests["low"]
                entries["docs"], entries["largest"] = 1, _NO_ID if doc_id is None else doc_id
                held.append(entries)
                count += len(own)
            if count >= HELD_ENTRIES:
                yield sent()
                held, count = [], 0
        if held:
            yield sent()

    return run


def _built(least: int):
    """The index of each shard, from its entries in any order."""

    def index(shard: int, entries: np.ndarray) -> dict:
        entries = entries[entries["docs"] >= least]
        levels = perfect_hash.built(entries["high"], entries["low"])
        at = perfect_hash.Places(levels).of(entries["high"], entries["low"])
        placed = np.empty_like(entries)
        placed[at] = entries
        sizes, bits = perfect_hash.to_bytes(levels)
        arrays = (sizes, bits, placed["low"].tobytes(), placed["docs"].tobytes(), placed["largest"].tobytes())
        return {"shard": shard, "lines": len(placed), **dict(zip(_INDEX, arrays))}

    schema = pa.schema([("shard", pa.int32()), ("lines", pa.int64()), *[(c, pa.binary()) for c in _INDEX]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, count, sum_ = None, [], 0, np.zeros(0, _ENTRY)
        for batch in batches:
            blobs = batch.column("asked")
            for i, at in enumerate(batch.column("shard").to_pylist()):
                if at != shard:
                    if shard is not None:
                        yield pa.RecordBatch.from_pylist([index(shard, _added(np.concatenate([sum_, *held])))], schema)
                    shard, held, count, sum_ = at, [], 0, np.zeros(0, _ENTRY)
                held.append(np.frombuffer(blobs[i].as_py(), _ENTRY))
                count += len(held[-1])
                if count >= HELD_ENTRIES:
                    sum_, held, count = _added(np.concatenate([sum_, *held])), [], 0
        if shard is not None:
            yield pa.RecordBatch.from_pylist([index(shard, _added(np.concatenate([sum_, *held])))], schema)

    return run


def _asking(shards: int, points: int):
    """The digests of the different lines of each lot, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, _, _, texts in by_lot(batches):
            own = set()
            for text in texts:
                own |= _line_digests(text, points)
            if own:
                digests = np.sort(np.frombuffer(b"".join(own), _DIGEST))
                yield _sent([(s, lot, part.tobytes()) for s, part in _by_shard(digests, shards)])

    return run


def _probed(least: int):
    """Looks the digests of lots up in the arrays of a shard, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = places = None
        schema = pa.schema([("lot", pa.int64()), ("answer", pa.binary())])
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i, at in enumerate(columns["shard"].to_pylist()):
                if columns["kind"][i].as_py() == 0:
                    sizes, bits, fingerprints, counts, largest = (columns[c][i].as_py() for c in _INDEX)
                    shard, places = at, perfect_hash.Places(perfect_hash.from_bytes(sizes, bits))
                    fingerprints = np.frombuffer(fingerprints, "<u8")
                    counts, largest = np.frombuffer(counts, "<i8"), np.frombuffer(largest, "<i8")
                    continue
                if at != shard or not places.size:
                    continue
                digests = np.frombuffer(columns["asked"][i].as_py(), _DIGEST)
                place = places.of(digests["high"], digests["low"])
                found = (place >= 0) & (fingerprints[place] == digests["low"]) & (counts[place] >= least)
                if found.any():
                    answer = np.zeros(int(found.sum()), _ENTRY)
                    answer["high"], answer["low"] = digests["high"][found], digests["low"][found]
                    answer["docs"], answer["largest"] = counts[place[found]], largest[place[found]]
                    lot = columns["lot"][i].as_py()
                    yield pa.RecordBatch.from_pylist([{"lot": lot, "answer": answer.tobytes()}], schema)

    return run


def _kept(points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())]
        )
        for _, answers, ids, texts in by_lot(batches):
            told = np.frombuffer(answers, _ENTRY)
            digests = np.empty(len(told), _DIGEST)
            digests["high"], digests["low"] = told["high"], told["low"]
            largest = dict(zip(map(bytes, digests.view("V16")), told["largest"].tolist()))
            lines_, dropped, kept = [], [], []
            for doc_id, text in zip(ids, texts):
                own = _NO_ID if doc_id is None else doc_id
                lines = text.split(b"\n")
                stay = [line for line in lines if largest.get(_digest(line, points), own) == own] if largest else lines
                lines_.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(text if len(stay) == len(lines) else b"\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], schema=schema,
            )

    return run


def _known(base: DataFrame) -> DataFrame:
    return base.withColumns({"kind": F.lit(1), "answer": F.lit(None).cast("binary")})


def line_index(base: DataFrame, shards: int, points: int = POINTS, least: int = LEAST) -> DataFrame:
    """One row per shard: the minimal perfect hash of its lines found in ``least`` documents, and the arrays it points to."""
    entries = _known(base).mapInArrow(_entries(shards, points), "shard int, lot long, asked binary")
    dealt = entries.repartition(shuffle_partitions(base.sparkSession), "shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(_built(least), _INDEX_SCHEMA), "line-index")


def probed(base: DataFrame, index: DataFrame, shards: int, points: int = POINTS, least: int = LEAST) -> DataFrame:
    """``lot, answer``: the lines of each lot that the index knows."""
    none = [F.lit(None).cast("binary").alias(c) for c in _INDEX]
    asked = _known(base).mapInArrow(_asking(shards, points), "shard int, lot long, asked binary")
    questions = asked.select("shard", F.lit(1).alias("kind"), "lot", "asked", *none)
    arrays = index.select(
        "shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("lot"), F.lit(None).cast("binary").alias("asked"), *_INDEX
    )
    both = arrays.unionByName(questions).repartition(shuffle_partitions(base.sparkSession), "shard")
    return both.sortWithinPartitions("shard", "kind").mapInArrow(_probed(least), "lot long, answer binary")


def deduplicated(docs: DataFrame, points: int = POINTS, least: int = LEAST) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every document."""
    base, sixteenths = lots(docs)
    shards = max(12, sixteenths // (SHARD_BYTES // 16_000_000))
    answers = probed(base, line_index(base, shards, points, least), shards, points, least)
    return with_answers(base, answers, _kept(points), _KEPT_SCHEMA)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), repeated AS (
  SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3
), m AS (
  SELECT k.*, repeated.key IS NULL OR doc_id IS NOT DISTINCT FROM largest AS stays
  FROM k LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY row, doc_id
"""
