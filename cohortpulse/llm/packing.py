"""Packing documents into sequences by lexical retrieval.

Tasks turn whole texts into ids, which are dealt to shards by a hash of the document and sorted there by a min-hash of
their tokens, so that texts that share words lie together. Document frequencies and the mean length are counted over all
documents. Each shard has one inverted index with BM25 weights of its tokens; the document that opens a window is its seed,
and the unused documents of the shard that score best for all tokens of the seed follow it until the window is full. The
last one is cut there, and what is left of it opens the next window. So all windows are full but the last of a shard, which
is cut into powers of two.

A task reads its documents in the order of the min-hashes and closes a shard at ``SHARD_TOKENS`` ids (a longer document
is held whole), so that it holds the ids and the index of one shard, whatever the size of the table, and all work grows in
proportion to it: within a shard work grows with the square of the documents. No group of documents is gathered by key, so a
source or group of copies that holds much of the corpus is spread over all tasks.

Cases: a null text is an empty one and packs as its closing id; repeated rows are packed each; a null ``doc_id`` is a
document; equal scores go to the first document of the shard; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import U64, documents, mixed, shuffle_partitions, text_pieces
from cohortpulse.llm.tokens import VOCABULARY, encoder
from cohortpulse.sources.scratch import written

LENGTH = 1024
END = 0
#: Ids are 16 bits wide.
IDS = 1 << 16
#: Ids of a shard.
SHARD_TOKENS = 2_000_000
#: Ids of pieces returned at a time.
BATCH_TOKENS = 2_000_000
#: Neighbours returned for one look; a window that is not full then looks again.
NEIGHBOURS = 16
#: A token that this share of the documents have has its weights as one row of all documents.
DENSE = 0.5
#: The index drops used documents when no more than this share is unused.
LEFT = 0.85
K1, B = 1.2, 0.75
#: Characters tokenised together: the more, the fewer words are encoded again.
PIECE = 8_000_000
#: Hash of every id; a document's least one sorts it.
_LEXICAL = (mixed(np.arange(1, IDS + 1, dtype=U64)) >> U64(1)).astype(np.int64)

_IDS = "doc_id long, lexical long, ids binary"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_pieces(texts, PIECE):
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                ids = [np.append(x, np.uint16(END)) for x in encode(part)]
                lexical = [int(_LEXICAL[x].min()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(lexical, pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "lexical", "ids"],
                )
        encoder(path).rest()

    return run


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a document in order, and how often each occurs."""
    if not len(ids):
        return ids, np.empty(0, np.int64)
    ordered = np.sort(ids, kind="stable")  # by radix, as 16 bits allow
    starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    return ordered[starts], np.diff(starts, append=len(ids))


class Corpus(NamedTuple):
    idf: np.ndarray  #: of every id
    mean: float  #: length of a document

    @classmethod
    def of(cls, docs: int, tokens: int, number: np.ndarray) -> Corpus:
        """From documents, their ids and how many documents have each id; the closing ids are not counted."""
        return cls(np.log(1 + (docs - number + 0.5) / (number + 0.5)), tokens / max(docs, 1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each id; -1 has the documents and -2 the ids."""
    number = np.zeros(IDS, np.int64)
    docs = tokens = 0
    for batch in batches:
        for blob in batch.column("ids").to_pylist():
            doc = np.frombuffer(blob, "<u2")[:-1]
            number[_distinct(doc)[0]] += 1
            docs, tokens = docs + 1, tokens + len(doc)
    seen = np.flatnonzero(number)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[seen, -1, -2].astype(np.int64)), pa.array(np.r_[number[seen], docs, tokens].astype(np.int64))],
        names=["token", "n"],
    )


def corpus(tokenised: DataFrame) -> Corpus:
    """Counted over all documents; the driver gets a row for each id of the vocabulary at most."""
    counts = tokenised.select("ids").mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {r["token"]: r["n"] for r in counts.collect()}
    docs, tokens = found.pop(-1, 0), found.pop(-2, 0)
    number = np.zeros(IDS, np.int64)
    number[list(found)] = list(found.values())
    return Corpus.of(docs, tokens, number)


class _Index:
    """Inverted index of a shard: for each token its documents and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], whole: Corpus | None = None):
        found = [_distinct(d[:-1]) for d in docs]  # every document has the closing id
        lengths = np.fromiter((len(d) - 1 for d in docs), np.int64, len(docs))
        distinct = np.fromiter((len(t) for t, _ in found), np.int64, len(docs))
        token = np.concatenate([t for t, _ in found]).astype(np.uint16)
        often = np.concatenate([n for _, n in found]).astype(np.float32)
        del found
        number = np.bincount(token, minlength=IDS)
        idf, mean = whole or Corpus.of(len(docs), int(lengths.sum()), number)
        doc = np.repeat(np.arange(len(docs)), distinct)
        norm = (K1 * (1 - B + B * lengths / max(mean, 1))).astype(np.float32)
        weight = idf.astype(np.float32)[token] * often * np.float32(K1 + 1) / (often + norm[doc])
        # all tokens of a document are asked for; one that no other document has leads nowhere
        self.query = token
        self.query_of = np.r_[0, np.cumsum(distinct)]
        self.number = number
        many = np.flatnonzero(number >= max(2, DENSE * len(docs)))
        self.row = np.full(IDS, -1, np.int32)
        self.row[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), len(docs)), np.float32)
        row = self.row[token]
        self.dense[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        token, doc, weight = token[row < 0], doc[row < 0], weight[row < 0]
        order = np.argsort(token, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(float)
        self.bounds = np.r_[0, np.cumsum(np.bincount(token, minlength=IDS))]
        self.indexed = np.arange(len(docs))
        self.unused = np.ones(len(docs), bool)
        self.asked, self.score = -1, np.zeros(len(docs))

    def _shrunk(self) -> None:
        """Used documents are found no more."""
        stays = self.unused[self.indexed]
        place = np.cumsum(stays) - 1
        kept = stays[self.doc]
        self.bounds = np.r_[0, np.cumsum(kept)][self.bounds]
        self.doc, self.weight = place[self.doc[kept]], self.weight[kept]
        self.dense = self.dense[:, stays]
        self.indexed = self.indexed[stays]
        self.asked = -1

    def _scored(self, seed: int) -> None:
        tokens = self.query[self.query_of[seed] : self.query_of[seed + 1]]
        tokens = tokens[self.number[tokens] > 1]
        rows = self.row[tokens]
        tokens, rows = tokens[rows < 0].astype(np.int64), rows[rows >= 0]
        starts, sizes = self.bounds[tokens], self.bounds[tokens + 1] - self.bounds[tokens]
        before = np.cumsum(sizes) - sizes
        entries = np.arange(sizes.sum()) + np.repeat(starts - before, sizes)
        self.asked, self.score = seed, np.zeros(len(self.indexed))
        self.score += np.bincount(self.doc[entries], self.weight[entries], len(self.score))
        if len(rows):
            self.score += self.dense[rows].sum(axis=0)

    def neighbours(self, seed: int) -> np.ndarray:
        """The best unused documents for a seed, best first; none if no unused document has a token of it."""
        if np.count_nonzero(self.unused) < LEFT * len(self.indexed):
            self._shrunk()
        if seed != self.asked:
            self._scored(seed)
        found = np.flatnonzero((self.score > 0) & self.unused[self.indexed])
        score = self.score[found]
        if len(found) > NEIGHBOURS:
            best = score >= np.partition(score, -NEIGHBOURS)[-NEIGHBOURS]
            found, score = found[best], score[best]
        return self.indexed[found[np.lexsort((found, -score))][:NEIGHBOURS]]


def pack(
    docs: list[np.ndarray], length: int = LENGTH, whole: Corpus | None = None
) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(document, start, length)``; every id of every document lies in exactly one. Without ``whole`` the
    documents are all there are."""
    index = _Index(docs, whole)
    sequences: list[list[tuple[int, int, int]]] = []
    room, following = 0, 0

    def place(doc: int) -> None:
        nonlocal room
        index.unused[doc] = False
        start, total = 0, len(docs[doc])
        while start < total:
            if not room:
                sequences.append([])
                room = length
            take = min(room, total - start)
            sequences[-1].append((doc, start, take))
            start, room = start + take, room - take

    while True:
        while following < len(docs) and not index.unused[following]:
            following += 1
        if following == len(docs):
            break
        place(following)
        while room:
            window = len(sequences)
            found = index.neighbours(sequences[-1][0][0])
            for doc in found:
                place(int(doc))
                if len(sequences) > window or not room:
                    break
            if not len(found):
                break
    if room:
        sequences += _powers(sequences.pop())
    return sequences


def _powers(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence that is not full, cut into sequences whose lengths are powers of two."""
    left = sum(n for _, _, n in sequence)
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for doc, start, n in sequence:
        while n:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                out.append([])
            take = min(room, n)
            out[-1].append((doc, start, take))
            start, n, room = start + take, n - take, room - take
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and tokens of consecutive documents, up to ``SHARD_TOKENS`` in all or one document."""
    ids: list[int | None] = []
    docs: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            doc = np.frombuffer(blob, "<u2")
            if docs and held + len(doc) > SHARD_TOKENS:
                yield ids, docs
                ids, docs, held = [], [], 0
            ids.append(doc_id)
            docs.append(doc)
            held += len(doc)
    if docs:
        yield ids, docs


def _packed(length: int, with_ids: bool, whole: Corpus | None = None):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.binary()]
        names = [c.split()[0] for c in _PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for ids, docs in _shards(batches):
            rows, held = [], 0
            for parts in pack(docs, length, whole):
                offset = 0
                for doc, start, n in parts:
                    code = docs[doc][start : start + n].astype("<u4").tobytes()
                    rows.append(
                        (ids[doc], start, n, zlib.crc32(code), len(docs[doc]), sequence, offset, code if with_ids else None)
                    )
                    offset += n
                sequence += 1
                held += offset
                if held >= BATCH_TOKENS:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def sequences(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document of ``docs`` (``doc_id, text``); ``ids`` are little-endian unsigned 32-bit."""
    shards = shuffle_partitions(docs.sparkSession)
    tokenised = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenised(path), _IDS)
    tokenised = written(tokenised, "packing-ids")
    dealt = tokenised.repartition(shards, F.xxhash64("doc_id", "lexical")).sortWithinPartitions("lexical", "doc_id", "ids")
    return dealt.mapInArrow(_packed(length, with_ids, corpus(tokenised)), _PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(documents(spark, sf_dir), with_ids=False).drop("ids")
