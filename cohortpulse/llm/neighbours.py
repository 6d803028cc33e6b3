"""Approximate nearest neighbours by collision counting over single projections.

Vectors are dealt to blocks of about ``BLOCK`` rows by a hash of their id. A block projects its vectors on ``LINES`` random
directions and sorts each projection. A query opens a window around its own value on every line; enlarging the radius
widens all windows (virtual rehashing: no table is rebuilt), and only rows that enter a window are counted. A vector that
lies in the windows of at least ``COLLISIONS`` lines is verified with its true distance. A block is done with a query when
``k`` verified vectors lie within the radius, so nothing depends on a bucket size and no bucket has a cap.

Queries visit every block, so a block's answer is its own best ``k``; the best ``k`` of all blocks are the answer. Blocks
of up to ``4 k`` vectors, and windows that have outgrown the doubles, are verified whole, which loses nothing. A vector at the radius is found with a probability above 0.98 (binomial tail of 64 lines at 0.68 each, 35 needed).

Cases: vectors that are null, zero, of length 0 or hold null or non-finite components, and rows without id, take no part;
vectors of different length are never compared; rows with one id count once (the smallest vector); equal distances go to
the smaller id; with fewer than ``k`` candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 16384
LINES = 64
COLLISIONS = 35
GROWTH = 1.25
SEED = 5
QUERY_EVERY = 100
NEAREST = 10
_FOUND = "query_id long, vec_id long, score double"


class _Block:
    """The sorted projections of one block's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        first = np.r_[True, ids[1:] != ids[:-1]]
        self.ids, self.vectors = ids[first], vectors[first]
        rng = np.random.default_rng([SEED, vectors.shape[1]])
        self.directions = rng.standard_normal((vectors.shape[1], LINES))
        values = (self.vectors @ self.directions).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)

    def radius(self, k: int) -> float:
        """Where windows begin: well below the distances at which members of the block have ``k`` neighbours."""
        some = self.vectors[:: max(1, len(self.ids) // 32)][:32]
        far = np.sort(np.array([_distances(self.vectors, q) for q in some]), axis=1)
        return max(0.7 * far[:, min(k, len(self.ids) - 1)].min(), 0.05 * np.median(far), 1e-12)

    def search(self, query_id: int, query: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        others = self.ids != query_id
        if n <= 4 * k:
            return self._best(np.flatnonzero(others), query, k)
        wanted = int(others.sum())
        centre = query @ self.directions
        hits = np.zeros(n, np.int32)
        verified = np.zeros(n, bool)
        checked = ~others
        near = np.zeros(n)
        low = high = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre)])
        while True:
            wider_low = np.array([np.searchsorted(v, c - radius) for v, c in zip(self.values, centre)])
            wider_high = np.array([np.searchsorted(v, c + radius, side="right") for v, c in zip(self.values, centre)])
            entered = [o[a:b] for o, a, b in zip(self.order, wider_low, low)]
            entered += [o[a:b] for o, a, b in zip(self.order, high, wider_high)]
            hits += np.bincount(np.concatenate(entered), minlength=n).astype(np.int32)
            low, high = wider_low, wider_high
            new = np.flatnonzero((hits >= COLLISIONS) & ~checked)
            near[new] = _distances(self.vectors[new], query)
            checked[new] = verified[new] = True
            found = int(verified.sum())
            if found == wanted or found >= k and np.count_nonzero(near[verified] <= radius) >= k:
                return self._best(np.flatnonzero(verified), query, k)
            radius *= GROWTH
            if not radius < np.inf:
                return self._best(np.flatnonzero(others), query, k)

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = _distances(self.vectors[rows], query)
        best = np.lexsort((self.ids[rows], score))[:k]
        return self.ids[rows][best], score[best]


def _distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    difference = vectors - query
    return np.sqrt((difference * difference).sum(axis=1))


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (dim, block), a block's vectors before its queries."""
        at, ids, vectors, block, radius, last = None, [], [], None, 0.0, None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            embedding = batch.column(4)
            for a, b in zip(np.r_[0, ends].astype(int), np.r_[ends, batch.num_rows].astype(int)):
                dim, number, is_query = (int(c[a]) for c in columns[:3])
                part = embedding.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                part = part.astype(np.float64).reshape(b - a, dim)
                if at != (dim, number):
                    at, ids, vectors, block, last = (dim, number), [], [], None, None
                if not is_query:
                    ids.append(columns[3][a:b])
                    vectors.append(part)
                    continue
                if block is None and ids:
                    block = _Block(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [], []
                    radius = block.radius(k)
                out = []
                for query_id, query in zip(columns[3][a:b], part):
                    if block is not None and query_id != last:
                        found, score = block.search(query_id, query, k, radius)
                        out.append((np.full(len(found), query_id), found, score))
                    last = query_id
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([o[i] for o in out])) for i in range(3)],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest other rows found for every row that ``is_query`` selects.

    ``vectors`` has ``vec_id`` and ``embedding``.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "embedding", lambda x: x != 0
    )
    valid = vectors.where(F.col("vec_id").isNotNull() & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.size("embedding").alias("dim"),
        is_query.alias("asks"),
    )
    blocks = max(1, -(-vectors.count() // BLOCK))
    members = valid.select(
        "dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("query"), "vec_id",
        "embedding",
    )
    questions = valid.where("asks").select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("query"), "vec_id",
        "embedding",
    )
    found = (
        members.unionByName(questions)
        .repartitionById(blocks, "block")
        .sortWithinPartitions("dim", "block", "query", "vec_id", "embedding")
        .mapInArrow(_searcher(k), _FOUND)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % QUERY_EVERY == 0)
