"""Questions about hashes, asked by lots of documents and answered by shards of the hash space.

Finding repeats needs a look at every window of every text, but only a verdict on few. Documents are therefore written
once in small compressed lots; a lot sends packed arrays of hashes to shards, each shard answers the lots, and the documents of a lot
meet the answers in one task. Rows of the shuffle are arrays, not single windows, and a passage that many documents share
is asked for once a lot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortpulse.llm.common import shuffle_partitions
from cohortpulse.sources.scratch import written

#: A lot is closed when it has so many documents or bytes of text.
LOT_DOCS, LOT_BYTES = 256, 1_000_000
#: Text whose hashes one shard holds.
SHARD_BYTES = 16_000_000

_LOT = "lot long, ids binary, nulls binary, lengths binary, text binary, size long"
_ASKED = "shard int, lot long, asked binary"
_ANSWER = "lot long, answer binary"
_PARTS = ("ids", "nulls", "lengths", "text")


def _packed_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive documents of a task as one row: their ids, lengths and, compressed together, texts."""
    lot = TaskContext.get().partitionId() << 33
    pack = zstandard.ZstdCompressor(level=3)
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def closed() -> pa.RecordBatch:
        row = {
            "lot": lot,
            "ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
            "nulls": np.array([i is None for i in ids], "u1").tobytes(),
            "lengths": np.array([len(t) for t in texts], "<i8").tobytes(),
            "text": pack.compress(b"".join(texts)),
            "size": size,
        }
        return pa.RecordBatch.from_pylist([row], schema=_LOT_SCHEMA)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids.append(doc_id)
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if len(ids) == LOT_DOCS or size >= LOT_BYTES:
                yield closed()
                lot, ids, texts, size = lot + 1, [], [], 0
    if ids:
        yield closed()


_LOT_SCHEMA = pa.schema([("lot", pa.int64()), *[(c, pa.binary()) for c in _PARTS], ("size", pa.int64())])


def lots(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents in lots, written so that lots are settled, and the number of shards for texts of their size."""
    packed_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed_lots, _LOT)
    base = written(packed_, "repeat-lots")
    size = base.agg(F.sum("size")).first()[0] or 0
    return base, max(12, -(-size // SHARD_BYTES))


def by_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[int | None], list[bytes]]]:
    """``lot, answers, ids, texts`` of each lot; ``answers`` are all that arrived for it, one after another.

    Rows are sorted by lot, answers before documents.
    """
    unpack = zstandard.ZstdDecompressor()
    lot, answers = None, []
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i, (at, kind) in enumerate(zip(columns["lot"].to_pylist(), columns["kind"].to_pylist())):
            if at != lot:
                lot, answers = at, []
            if kind == 0:
                answers.append(columns["answer"][i].as_py())
                continue
            ids, nulls, lengths, text = (columns[c][i].as_py() for c in _PARTS)
            ends = np.cumsum(np.frombuffer(lengths, "<i8"))
            whole = unpack.decompress(text)
            texts = [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            known = np.frombuffer(ids, "<i8").tolist()
            yield lot, b"".join(answers), [None if n else d for d, n in zip(known, nulls)], texts


def with_answers(base: DataFrame, answers: DataFrame | None, run: Callable, schema: str) -> DataFrame:
    """``run`` over the documents of each lot together with the answers to it."""
    docs = base.select("lot", F.lit(1).alias("kind"), *_PARTS, F.lit(None).cast("binary").alias("answer"))
    if answers is None:
        return docs.mapInArrow(run, schema)
    told = answers.select("lot", F.lit(0).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in _PARTS], "answer")
    return (
        told.unionByName(docs)
        .repartition(shuffle_partitions(base.sparkSession), "lot")
        .sortWithinPartitions("lot", "kind")
        .mapInArrow(run, schema)
    )


def asked(base: DataFrame, answers: DataFrame | None, run: Callable) -> DataFrame:
    return with_answers(base, answers, run, _ASKED)


def answered(questions: DataFrame, decide: Callable, label: str) -> DataFrame:
    """``decide(shard, [(lot, asked), ...])`` yields ``(lot, answer)``; it sees one shard at a time. Written, so that the
    questions' shuffle is done with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def decided() -> Iterator[pa.RecordBatch]:
            rows = list(decide(held))
            if rows:
                lot, answer = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lot, pa.int64()), pa.array(answer, pa.binary())], names=["lot", "answer"]
                )

        for batch in batches:
            for i, at in enumerate(batch.column("shard").to_pylist()):
                if at != shard and held:
                    yield from decided()
                    held = []
                shard = at
                held.append((batch.column("lot")[i].as_py(), batch.column("asked")[i].as_py()))
        if held:
            yield from decided()

    n = shuffle_partitions(questions.sparkSession)
    dealt = questions.repartition(n, "shard").sortWithinPartitions("shard", "lot")
    return written(dealt.mapInArrow(run, _ANSWER), label)


def packed(shards: list[int], lots_: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int32()), pa.array(lots_, pa.int64()), pa.array(blobs, pa.binary())],
        names=["shard", "lot", "asked"],
    )


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers by place: all lowest bytes, then all next ones. Sorted numbers then compress in the shuffle."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_planes(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()
