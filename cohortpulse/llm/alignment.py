"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, counted over the corpus.

Documents are tokenised in blocks. A block spills its pair-document records ``(B id, A id, document, times)``, dealt by
the radix of the B id and sorted side B first, as one zstd run for each radix. Counting reads the pair columns of the runs
only: the runs of ``FAN_IN`` blocks meet in one task for each radix, a k-way heap merge adds the equal pairs up, and rounds
go on until each radix is one run. As it comes side B first, the highest count of a B id is known when its pairs have
passed. The totals then stream against the records of ``FAN_IN`` blocks at a time, run by run, and contribute to the
documents; a document gets one contribution for each radix. A pair or a B id that holds most of the links is one entry
for each block when it is counted, and its records stay with their blocks.

Two tokens are linked, once for each pair of occurrences, when their byte ranges overlap. Vocabulary A encodes a space and
the text, B the text, before which it sets a space itself.

Cases: null and empty texts, and texts that one vocabulary does not give back byte by byte, have no tokens: all figures
are 0 and ``groups_sha256`` is empty; repeated rows are documents of their own; ties for the highest count of a B id are
all best; a very long text is worked through in parts and is a block of its own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import U64, documents, shuffle_partitions
from cohortpulse.llm.exchange import from_planes, planes
from cohortpulse.llm.word_alignment import DOC_BITS, PAIR_BITS, PIECES, RADIX, Block, aligner
from cohortpulse.llm.tokens import RANKS, VOCABULARY
from cohortpulse.sources.scratch import written

#: A block is closed at so many links or documents; the place of a document takes DOC_BITS bits.
BLOCK_LINKS, BLOCK_DOCS = 3_000_000, 8192
#: Blocks whose runs meet in one task.
FAN_IN = 32
#: Pairs of one row of a merged run.
CHUNK = 1 << 16

_RUNS = "block long, kind int, radix int, first long, pairs binary, records binary"
_TOTALS = "radix int, run long, first long, pairs binary"
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<i8", 4), ("told", "u1"), ("sha", "V32")])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(planes, arrays)))


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, start = len(data) // sum(widths), [], 0
    for kind, width in zip(kinds, widths):
        out.append(from_planes(data[start : start + n * width], kind))
        start += n * width
    return out


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)


_RUN_SCHEMA = pa.schema(
    [("block", pa.int64()), ("kind", pa.int32()), ("radix", pa.int32()), ("first", pa.int64()), ("pairs", pa.binary()),
     ("records", pa.binary())]
)
_TOTAL_SCHEMA = pa.schema([("radix", pa.int32()), ("run", pa.int64()), ("first", pa.int64()), ("pairs", pa.binary())])


def _spilled(block: int, held: Block) -> Iterator[pa.RecordBatch]:
    """A row with the documents of a block, and one run for each radix."""
    sums, digests, pairs, times = held.closed()
    docs = np.zeros(len(sums), _DOC)
    docs["doc_id"] = [i or 0 for i in held.ids]
    docs["null"] = [i is None for i in held.ids]
    docs["n"], docs["told"] = sums, [bool(d) for d in digests]
    docs["sha"] = np.frombuffer(b"".join(d or bytes(32) for d in digests), "V32")
    packed = zstandard.ZstdCompressor(level=1).compress(docs.tobytes())
    yield _batch(_RUN_SCHEMA, block=[block], kind=[0], radix=[-1], first=[0], pairs=[None], records=[packed])
    radix = (pairs >> U64(DOC_BITS + PAIR_BITS)).astype(np.int64)
    edges = np.searchsorted(radix, np.arange(RADIX + 1))
    key = ((pairs >> U64(DOC_BITS)) & U64((1 << PAIR_BITS) - 1)).astype(np.uint32)
    doc = (pairs & U64((1 << DOC_BITS) - 1)).astype(np.uint16)
    for r in range(RADIX):
        own = slice(edges[r], edges[r + 1])
        if edges[r] == edges[r + 1]:
            continue
        starts = np.flatnonzero(np.diff(key[own], prepend=np.uint32(0xFFFFFFFF)))
        sizes = np.diff(starts, append=edges[r + 1] - edges[r])
        totals = np.add.reduceat(times[own], starts)
        columns = _packed(key[own][starts], totals.astype("<i8"), sizes.astype("<u4"))
        records = _packed(doc[own], times[own].astype("<u4"))
        first = int(key[own][0])
        yield _batch(_RUN_SCHEMA, block=[block], kind=[1], radix=[r], first=[first], pairs=[columns], records=[records])


def _runs(path: str, ranks: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path, ranks, pieces)
        block, held = TaskContext.get().partitionId() << 33, Block(known)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.add(doc_id, text.as_py())
                if held.links >= BLOCK_LINKS or len(held.ids) == BLOCK_DOCS:
                    yield from _spilled(block, held)
                    block, held = block + 1, Block(known)
        if held.ids:
            yield from _spilled(block, held)

    return run


def _stretches(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way heap merge of ascending runs that arrive in the order of their first keys.

    The heap holds the next key of every open run. The run on top gives all its keys up to the next run's, so that the
    stretches come out in order; a run is opened only when its first key is reached.
    """
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def below(limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while heap and heap[0][0] < limit:
            _, order, keys, counts = heap[0]
            bound = min(limit, *(heap[k][0] for k in (1, 2) if k < len(heap))) if len(heap) > 1 else limit
            end = max(1, int(np.searchsorted(keys, bound)))
            yield keys[:end], counts[:end]
            if end == len(keys):
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (int(keys[end]), order, keys[end:], counts[end:]))

    for order, (keys, counts) in enumerate(rows):
        yield from below(int(keys[0]))
        heapq.heappush(heap, (int(keys[0]), order, keys, counts))
    yield from below(1 << 62)


def _summed(stretches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Equal neighbours added up, in chunks that end between B ids."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, least = 0, CHUNK

    def added() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.add.reduceat(counts, starts)

    for stretch in stretches:
        held.append(stretch)
        size += len(stretch[0])
        if size >= least:
            keys, counts = added()
            end = int(np.searchsorted(keys, keys[-1] >> 16 << 16))
            if end >= CHUNK // 2:
                yield keys[:end], counts[:end]
                keys, counts = keys[end:], counts[end:]
            held, size = [(keys, counts)], len(keys)
            least = size + CHUNK
    if held:
        yield added()


def _best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id; all pairs of a B id are there."""
    side = keys >> 16
    starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(starts, append=len(keys)))
    return counts == highest


def _merged(first: bool, last: bool):
    """One run for each (radix, run) of the rows; those of the last round carry what is best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, n, p) for b in batches for r, n, p in zip(*(b.column(c).to_pylist() for c in ("radix", "run", "pairs"))))
        row = next(rows, None)
        while row is not None:
            at = row[:2]

            def own() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                nonlocal row
                while row is not None and row[:2] == at:
                    yield _unpacked(row[2], "<u4", "<i8", "<u4")[:2] if first else tuple(_unpacked(row[2], "<u4", "<i8"))
                    row = next(rows, None)

            for keys, counts in _summed(_stretches(own())):
                flags = (_best(keys, counts).astype("u1"),) if last else ()
                blob = _packed(keys, counts, *flags)
                yield _batch(_TOTAL_SCHEMA, radix=[at[0]], run=[at[1]], first=[int(keys[0])], pairs=[blob])

    return run


def _contributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run the best links and the counts that it gives to every document of its block; totals come first."""
    schema = pa.schema([("block", pa.int64()), ("given", pa.binary())])
    at, totals, joined = None, [], None
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i, (radix, group, kind) in enumerate(zip(*(columns[c].to_pylist() for c in ("radix", "group", "kind")))):
            if at != (radix, group):
                at, totals, joined = (radix, group), [], None
            if kind == 0:
                totals.append(_unpacked(columns["pairs"][i].as_py(), "<u4", "<i8", "u1"))
                continue
            if joined is None:
                joined = [np.concatenate(x) for x in zip(*totals)]
                totals = []
            keys, _, sizes = _unpacked(columns["pairs"][i].as_py(), "<u4", "<i8", "<u4")
            doc, times = _unpacked(columns["records"][i].as_py(), "<u2", "<u4")
            place = np.searchsorted(joined[0], keys)
            sums = np.zeros((2, int(doc.max()) + 1), np.int64)
            np.add.at(sums[0], doc, times * np.repeat(joined[2][place].astype(np.int64), sizes))
            np.add.at(sums[1], doc, times * np.repeat(joined[1][place], sizes))
            blob = _packed(sums[0], sums[1])
            yield _batch(schema, block=[columns["block"][i].as_py()], given=[blob])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block's documents with all that was given to them."""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in names], ("groups_sha256", pa.string())])
    block, docs, sums = None, None, None

    def rows() -> pa.RecordBatch:
        hashes = [x.tobytes().hex() if told else "" for x, told in zip(docs["sha"], docs["told"])]
        numbers = [pa.array(x, pa.int64()) for x in (*docs["n"].T, *sums)]
        ids = pa.array(docs["doc_id"], pa.int64(), mask=docs["null"].astype(bool))
        return pa.RecordBatch.from_arrays([ids, *numbers, pa.array(hashes, pa.string())], schema=schema)

    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i, at in enumerate(columns["block"].to_pylist()):
            if columns["kind"][i].as_py() == 0:
                if docs is not None:
                    yield rows()
                data = zstandard.ZstdDecompressor().decompress(columns["given"][i].as_py())
                block, docs = at, np.frombuffer(data, _DOC)
                sums = np.zeros((2, len(docs)), np.int64)
                continue
            assert at == block
            given = _unpacked(columns["given"][i].as_py(), "<i8", "<i8")
            for total, part in zip(sums, given):
                total[: len(part)] += part
    if docs is not None:
        yield rows()


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def spilled(docs: DataFrame, path: str = VOCABULARY, ranks: str = RANKS, pieces: str = PIECES) -> DataFrame:
    """The runs of all blocks and a row with the documents of each (``kind`` 0); written."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(narrow.mapInArrow(_runs(path, ranks, pieces), _RUNS), "alignment-runs", "none")


def pair_totals(runs: DataFrame, groups: int) -> DataFrame:
    """``radix, first, pairs``: every pair of the corpus with its count and whether it is best for its B id."""
    n = shuffle_partitions(runs.sparkSession)
    level = runs.where("kind = 1").select("radix", _group(groups).cast("long").alias("run"), "first", "pairs")
    first = True
    while True:
        last = groups == 1
        dealt = level.repartition(n, "radix", "run").sortWithinPartitions("radix", "run", "first")
        level = dealt.mapInArrow(_merged(first, last), _TOTALS)
        if last:
            return written(level, "alignment-totals", "none")
        first, groups = False, -(-groups // FAN_IN)
        level = level.withColumn("run", F.expr(f"run div {FAN_IN}"))


def _group(groups: int):
    return F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")


def aligned_documents(runs: DataFrame) -> DataFrame:
    """One row per document with its figures."""
    n = shuffle_partitions(runs.sparkSession)
    groups = max(1, -(-runs.where("kind = 0").count() // FAN_IN))
    totals = pair_totals(runs, groups)
    none = F.lit(None).cast("binary")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    told = totals.select(
        "radix", everywhere.alias("group"), F.lit(0).alias("kind"), "first", F.lit(0).cast("long").alias("block"), "pairs",
        none.alias("records"),
    )
    own = runs.where("kind = 1").select("radix", _group(groups).alias("group"), "kind", "first", "block", "pairs", "records")
    given = (
        told.unionByName(own)
        .repartition(n, "radix", "group")
        .sortWithinPartitions("radix", "group", "kind", "first")
        .mapInArrow(_contributed, "block long, given binary")
    )
    parts = runs.where("kind = 0").select("block", "kind", F.col("records").alias("given"))
    return (
        parts.unionByName(given.select("block", F.lit(1).alias("kind"), "given"))
        .repartition(n, "block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(_documents, _RESULT)
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(spilled(documents(spark, sf_dir)))
