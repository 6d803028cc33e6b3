"""MinHash near-dedup of whole texts.

1. Tasks compute each text's set of word shingles, a 128-bit fingerprint of the set and ``HASHES`` universal-hash minima.
   Documents with equal sets form a class; one member of a class goes on.
2. Bands of ``ROWS`` minima are keys. In a key's bucket one member is the leader; every other one is a candidate pair with
   it. So a bucket of n members gives n - 1 pairs.
3. A pair whose minima agree too rarely is dropped (``LEAST_AGREEING``: below it a similar pair has a chance under 1e-7);
   the others are confirmed on their full sets.
4. Confirmed links give components by large-star and small-star.
5. Buckets whose members are not all in one component are taken up again, with another leader (``ROUNDS``), then with all
   pairs across components, tile by tile inside tasks, so that no link is lost to the choice of leaders. Pairs that are
   already connected are never looked at again.

A pair at the similarity limit misses all 32 bands with probability (1 - 0.75^4)^32 < 6e-6.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer than five
words is one shingle; repeated rows are a class; a null ``doc_id`` sorts last within its component; an empty table gives an
empty result; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import U64, documents, mixed, pieces, shuffle_partitions, staying
from cohortpulse.llm.components import components
from cohortpulse.llm.shingles import shingle_sets
from cohortpulse.sources.scratch import written

SHINGLE = 5
PERCENT = 75
HASHES, ROWS = 128, 4
LEAST_AGREEING = 68
ROUNDS = 2
#: Members of a leader that one task confirms, and the side of a tile.
SHARE, TILE = 512, 1024
PIECE = 1_000_000

_rng = np.random.default_rng(17)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

_MEASURED = "doc_id long, text_hash long, n long, set_a long, set_b long, minima binary"


def minima(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, HASHES) smallest value of each hash function; texts without shingles keep the largest value."""
    out = np.full((len(counts), HASHES), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((hashes * _A[k] + _B[k]) >> U64(32), starts)
    return out


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values)])
    ends = np.cumsum(counts)
    return (total[ends] - total[ends - counts]).view(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in pieces(np.array([len(t) if t else 0 for t in texts]), PIECE):
            hashes, counts = shingle_sets([t.encode() if t else b"" for t in texts[a:b]], SHINGLE)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    batch.column("text_hash").slice(a, b - a),
                    pa.array(counts, pa.int64()),
                    pa.array(_sums(mixed(hashes), counts)),
                    pa.array(_sums(mixed(hashes ^ U64(0xA5A5A5A5A5A5A5A5)), counts)),
                    pa.array([m.tobytes() for m in minima(hashes, counts)], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n", "set_a", "set_b", "minima"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = HASHES // ROWS
    for batch in batches:
        m = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(-1, HASHES).astype(U64)
        key = np.tile(np.arange(bands, dtype=U64), (len(m), 1))
        for r in range(ROWS):
            key = mixed((key * U64(0x9E3779B97F4A7C15) + m[:, r::ROWS]).ravel()).reshape(key.shape)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.ravel().view(np.int64)),
                pa.array(np.tile(np.arange(bands, dtype=np.int32), len(m))),
                pa.array(np.repeat(batch.column("node").to_numpy(), bands)),
            ],
            names=["key", "band", "node"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def _leaders(bands: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """``leader, node``: in each bucket one member, chosen by a hash, against the others of other components."""
    dice = F.struct(F.xxhash64("node", F.lit(turn)).alias("dice"), F.col("node").alias("leader"), F.col("label").alias("led"))
    marked = bands.withColumn("label", F.col("node")) if labels is None else bands.join(labels, "node")
    leaders = (
        marked.groupBy("key")
        .agg(F.min(dice).alias("first"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low != high")
        .select(F.col("key").alias("bucket"), "first.leader", "first.led")
    )
    pairs = marked.join(leaders, F.col("key") == F.col("bucket")).where("label != led").select("leader", "node")
    return pairs.distinct()


def _side(sets: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(sets, F.col("node") == F.col("set_node"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``leader, node``) whose full sets are similar. A leader's pairs are dealt to as many tasks as they need;
    each holds the leader's set once and reads the others as a stream."""
    pairs = written(pairs, "near-pairs")
    sizes = pairs.groupBy("leader").agg((F.floor(F.count("*") / SHARE) + 1).cast("int").alias("shares"))
    sizes = sizes.withColumnRenamed("leader", "led")
    part = F.pmod(F.xxhash64("node"), F.col("shares").cast("long")).cast("int").alias("part")
    members = _side(sets, pairs.join(sizes, F.col("leader") == F.col("led")).select("leader", part, "node"))
    heads = sizes.select(F.col("led").alias("node"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"))
    heads = _side(sets, heads)
    members = members.select("leader", "part", F.lit(1).alias("kind"), "node", "text", "minima")
    heads = heads.select(F.col("node").alias("leader"), "part", F.lit(0).alias("kind"), "node", "text", "minima")
    n = shuffle_partitions(pairs.sparkSession)
    return (
        heads.unionByName(members)
        .repartition(n, "leader", "part")
        .sortWithinPartitions("leader", "part", "kind", "node")
        .mapInArrow(_confirm, "u long, v long")
    )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, head, head_minima = None, None, None
    for batch in batches:
        leaders, kinds = batch.column("leader").to_numpy(), batch.column("kind").to_numpy()
        nodes = batch.column("node").to_numpy()
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        lows = [np.frombuffer(m, np.uint32) for m in batch.column("minima").to_pylist()]
        found = []
        for a, b in pieces(np.array([len(t) for t in texts]), PIECE):
            hashes, counts = shingle_sets(texts[a:b], SHINGLE)
            ends = np.cumsum(counts)
            for i in range(a, b):
                own = hashes[ends[i - a] - counts[i - a] : ends[i - a]]
                if kinds[i] == 0:
                    at, head, head_minima = leaders[i], own.copy(), lows[i]
                    continue
                assert at == leaders[i]
                if np.count_nonzero(lows[i] == head_minima) < LEAST_AGREEING:
                    continue
                place = np.searchsorted(head, own)
                common = np.count_nonzero(head[np.minimum(place, len(head) - 1)] == own)
                if 100 * common >= PERCENT * (len(head) + len(own) - common):
                    found.append((leaders[i], nodes[i]))
        if found:
            u, v = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _open_links(bands: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v``: links that join different components, from all pairs of members of one bucket, compared inside tasks.

    A bucket is a square of tiles of ``TILE`` members a side, so that none is too large for a task; a tile gives a forest
    of links at most, never its pairs.
    """
    marked = bands.join(labels, "node")
    buckets = (
        marked.groupBy("key")
        .agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low != high")
        .select(F.col("key").alias("bucket"), (F.floor((F.col("members") - 1) / TILE) + 1).alias("sides"))
    )
    placed = (
        marked.join(buckets, F.col("key") == F.col("bucket"))
        .withColumn("side", F.pmod(F.xxhash64("node", F.lit(2)), F.col("sides")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
        .select("key", "band", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "node", "label")
    )
    members = _side(sets, placed)
    return (
        members.repartition(shuffle_partitions(bands.sparkSession), "key", "x", "y")
        .sortWithinPartitions("key", "x", "y", "side", "node")
        .select("key", "x", "y", "band", "side", "node", "label", "minima", "text")
        .mapInArrow(_tiles, "u long, v long")
    )


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come tile by tile; a tile's members are few by construction."""
    at: tuple | None = None
    held: list[tuple] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, x, y, *rest in zip(*columns):
            if at != (key, x, y):
                if held:
                    yield from _forest(at, held)
                at, held = (key, x, y), []
            held.append(tuple(rest))
    if held:
        yield from _forest(at, held)


def _forest(tile: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Links between components found in one tile. A pair that shares several buckets is compared in that of its first
    common band only."""
    _, x, y = tile
    band = held[0][0]
    sides, nodes, part = (np.array([h[i] for h in held]) for i in (1, 2, 3))
    if len(np.unique(part)) == 1:
        return
    m = np.stack([np.frombuffer(h[4], np.uint32) for h in held])
    hashes, counts = shingle_sets([h[5].encode() for h in held], SHINGLE)
    ends = np.cumsum(counts)
    found: list[tuple[int, int]] = []
    right = np.flatnonzero(sides == y)
    for i in np.flatnonzero(sides == x):
        others = right[part[right] != part[i]]
        if x == y:
            others = others[others > i]
        others = others[np.abs(counts[others] - counts[i]) * 100 <= (100 - PERCENT) * np.maximum(counts[others], counts[i])]
        same = m[others] == m[i]
        close = same.sum(axis=1) >= LEAST_AGREEING
        first = same[close].reshape(-1, HASHES // ROWS, ROWS).all(axis=2).argmax(axis=1) == band
        others = others[close][first]
        if not len(others):
            continue
        own = hashes[ends[i] - counts[i] : ends[i]]
        theirs = np.concatenate([hashes[ends[j] - counts[j] : ends[j]] for j in others])
        place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        size = counts[others]
        common = np.add.reduceat((own[place] == theirs).astype(np.int64), np.cumsum(size) - size)
        for j in others[100 * common >= PERCENT * (size + counts[i] - common)]:
            if part[i] != part[j]:
                found.append((int(nodes[i]), int(nodes[j])))
                part[part == part[j]] = part[i]
    if found:
        u, v = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _labels(classes: DataFrame, links: DataFrame | None) -> DataFrame:
    """``node, label`` of every class."""
    if links is None:
        return classes.select("node", F.col("node").alias("label"))
    found = components(links).withColumnRenamed("node", "member")
    joined = classes.select("node").join(found, F.col("node") == F.col("member"), "left")
    return written(joined.select("node", F.coalesce("component", "node").alias("label")), "near-labels")


def _joined(classes: DataFrame, labels: DataFrame, new: DataFrame) -> DataFrame:
    """``node, label`` after ``new`` links. What was found before enters as one link from each node to its label, which the
    star steps leave as it is where nothing new meets it."""
    new = written(new.select("u", "v"), "near-links")
    if new.isEmpty():
        return labels
    stars = labels.where("node != label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    return _labels(classes, stars.union(new))


def groups(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text_hash, n, component_id, first`` of every row: ``first`` marks one row of each component.

    ``component_id`` is the smallest ``doc_id`` of the component.
    """
    measured = _keyed(docs).select("doc_id", "text_hash", "text").mapInArrow(_measure, _MEASURED)
    rows = written(measured.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    by_set = ["n", "set_a", "set_b"]
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("low"), F.col("row").alias("node")))
    classes = written(rows.where("n > 0").groupBy(*by_set).agg(first.alias("f")).select(*by_set, "f.node"), "near-classes")
    kept = rows.select("row", "doc_id", "text_hash", "minima").join(classes.select("node"), F.col("row") == F.col("node"))
    kept = written(kept.drop("row"), "near-kept")
    sketches = kept.select("node", "minima")
    bands = written(sketches.select("minima", "node").mapInArrow(_bands, "key long, band int, node long"), "near-bands")
    # buckets of one member are done
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "bucket")
    bands = written(bands.join(shared, F.col("key") == F.col("bucket")).select("key", "band", "node"), "near-shared")
    wanted = bands.select("node").distinct().withColumnRenamed("node", "wanted")
    wanted = kept.join(wanted, F.col("node") == F.col("wanted")).select(
        F.col("node").alias("set_node"), F.col("doc_id").alias("set_doc"), F.col("text_hash").alias("set_hash"), "minima"
    )
    keyed = _keyed(docs)
    same = (keyed["text_hash"] == F.col("set_hash")) & keyed["doc_id"].eqNullSafe(F.col("set_doc"))
    sets = keyed.join(wanted, same).select("set_node", "text", "minima").dropDuplicates(["set_node"])
    sets = written(sets, "near-sets", "zstd")

    labels = _labels(classes, None)
    for turn in range(ROUNDS):
        new = _confirmed(_leaders(bands, None if turn == 0 else labels, turn), sets)
        labels = _joined(classes, labels, new)
    labels = _joined(classes, labels, _open_links(bands, labels, sets))

    labelled = classes.join(labels.withColumnRenamed("node", "member"), F.col("node") == F.col("member"))
    labelled = labelled.select(*[F.col(c).alias(f"{c}_of") for c in by_set], "label")
    equal = [F.col(c) == F.col(f"{c}_of") for c in by_set]
    condition: Column = equal[0] & equal[1] & equal[2]
    rows = rows.select("row", "doc_id", "text_hash", *by_set).join(labelled, condition, "left")
    rows = written(rows.select("row", "doc_id", "text_hash", "n", F.coalesce("label", F.col("row")).alias("label")), "near-out")
    smallest = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("low"), "doc_id", "row"))
    names = rows.groupBy("label").agg(smallest.alias("s")).select(
        F.col("label").alias("named"), F.col("s.doc_id").alias("component_id"), F.col("s.row").alias("first_row")
    )
    return rows.join(names, F.col("label") == F.col("named")).select(
        "row", "doc_id", "text_hash", "n", "component_id", (F.col("row") == F.col("first_row")).alias("first")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, of which one of each component stays."""
    return staying(docs, groups(docs).select("doc_id", "text_hash", F.col("first").alias("stays")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN
    range(1, CASE WHEN len(words) = 0 THEN 1 ELSE greatest(len(words) - 3, 2) END)]) AS shingles
  FROM d
), n AS (
  SELECT doc_id, len(shingles) AS size FROM s
), e AS MATERIALIZED (
  SELECT doc_id, unnest(shingles) AS shingle FROM s
), shared AS (
  SELECT a.doc_id AS one, b.doc_id AS other, count(*) AS common
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT one, other FROM shared JOIN n a ON a.doc_id = one JOIN n b ON b.doc_id = other
  WHERE 100 * common >= 75 * (a.size + b.size - common)
), reach AS (
  SELECT doc_id, doc_id AS reached FROM n
  UNION
  SELECT doc_id, other FROM reach JOIN links ON one = reached
)
SELECT doc_id, size AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept
FROM reach JOIN n USING (doc_id) GROUP BY doc_id, size
"""
