"""Exact dedup by a tree merge of sorted digest runs.

Every task turns its rows into runs sorted by digest. In each round the runs of ``fan_in`` neighbouring partitions meet
in one task for each range of digests, which merges them as streams of chunks: a digest found more than once leaves one
entry, the best row so far and the number of rows. After the last round each range of digests is one run with one entry
per text. Rounds move digests, never texts, and a group of copies is one entry per run from the first round on.

Texts are equal when they are identical without ASCII white space. Of equal texts the longest original (code points)
stays, then the smallest ``doc_id``, null last, then the first row. Entries carry the normalised length besides the
SHA-256 digest; two lengths under one digest end the job.

Cases: a null text counts as empty, and empty texts equal each other; repeated rows are a group of which one stays; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import documents, shuffle_partitions, staying, without_spaces
from cohortpulse.sources.scratch import written

FAN_IN = 8
CHUNK = 1 << 14
ENTRY = np.dtype(
    [("digest", "<u8", 4), ("norm", "<i8"), ("points", "<i8"), ("null", "u1"), ("doc", "<i8"), ("row", "<i8"), ("rows", "<i8")]
)
_RUN = "shard int, run long, first binary, entries binary"
_KEPT = "keep_digest binary, keep_id long, keep_null boolean, keep_row long, group_size long"


def _reduced(entries: np.ndarray) -> np.ndarray:
    """Sorted by digest, one entry for each: the row that stays and the number of rows."""
    if not len(entries):
        return entries
    digest = entries["digest"]
    keys = [entries["row"], entries["doc"], entries["null"], -entries["points"], *(digest[:, k] for k in (3, 2, 1, 0))]
    order = np.lexsort(keys)
    entries, digest = entries[order], digest[order]
    new = np.ones(len(entries), bool)
    new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    same = np.cumsum(new) - 1
    if (entries["norm"] != entries["norm"][starts][same]).any():
        raise ValueError("two texts of different length have the same SHA-256 digest")
    out = entries[starts].copy()
    out["rows"] = np.add.reduceat(entries["rows"], starts)
    return out


def _bytes(digest: np.ndarray) -> bytes:
    return digest.astype(">u8").tobytes()


def _chunks(shard: int, run: int, entries: np.ndarray) -> Iterator[tuple]:
    for i in range(0, len(entries), CHUNK):
        part = entries[i : i + CHUNK]
        yield shard, run, _bytes(part["digest"][0]), part.tobytes()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["shard", "run", "first", "entries"])


def _first_runs(shards: int):
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries = np.zeros(len(batch), ENTRY)
            entries["digest"] = np.frombuffer(b"".join(batch["digest"]), ">u8").reshape(-1, 4)
            entries["norm"], entries["points"] = batch["norm"], batch["points"]
            entries["null"], entries["doc"] = batch["no_id"], batch["known_id"]
            entries["row"], entries["rows"] = batch["row"], 1
            entries = _reduced(entries)
            shard = ((entries["digest"][:, 0] >> np.uint64(33)) * np.uint64(shards)) >> np.uint64(31)
            rows = []
            for s in np.unique(shard):
                rows += _chunks(int(s), int(batch["run"].iloc[0]), entries[shard == s])
            if rows:
                yield _frame(rows)

    return runs


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Multiway merge of chunks that arrive by (shard, run, first digest).

    A chunk's first digest bounds what later chunks can hold, so all entries below it are final. What stays open is one
    stretch of each run.
    """
    at, open_entries, ready, held = None, np.zeros(0, ENTRY), [], 0

    def flushed(key) -> list[tuple]:
        done = np.concatenate(ready) if ready else np.zeros(0, ENTRY)
        return list(_chunks(*key, done))

    for batch in batches:
        for shard, run, first, blob in zip(batch["shard"], batch["run"], batch["first"], batch["entries"]):
            chunk = np.frombuffer(blob, ENTRY)
            if at != (shard, run):
                if at is not None:
                    ready.append(_reduced(open_entries))
                    if rows := flushed(at):
                        yield _frame(rows)
                at, open_entries, ready, held = (shard, run), chunk, [], 0
                continue
            open_entries = _reduced(np.concatenate([open_entries, chunk]))
            final = _below(open_entries, bytes(first))
            ready.append(open_entries[:final])
            held += final
            open_entries = open_entries[final:]
            if held >= CHUNK:
                yield _frame(flushed(at))
                ready, held = [], 0
    if at is not None:
        ready.append(_reduced(open_entries))
        if rows := flushed(at):
            yield _frame(rows)


def _below(entries: np.ndarray, first: bytes) -> int:
    low, high = 0, len(entries)
    while low < high:
        mid = (low + high) // 2
        if _bytes(entries["digest"][mid]) < first:
            low = mid + 1
        else:
            high = mid
    return low


def _winners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for blob in batch["entries"]:
            e = np.frombuffer(blob, ENTRY)
            yield pd.DataFrame(
                {
                    "keep_digest": [_bytes(x) for x in e["digest"]],
                    "keep_id": pd.array(np.where(e["null"], 0, e["doc"]), "Int64").copy(),
                    "keep_null": e["null"].astype(bool),
                    "keep_row": e["row"].astype("int64"),
                    "group_size": e["rows"].astype("int64"),
                }
            )


def _decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last merge and its winners in one worker; as two steps of one stage they would hold two workers a task."""
    return _winners(_merge(batches))


def measured(docs: DataFrame) -> DataFrame:
    """``row, run, doc_id, digest, points, norm, text_hash`` of every row; written once, so that ``row`` is settled."""
    norm = without_spaces(F.col("text"))
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().cast("long").alias("run"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(norm, 256)).alias("digest"),
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"),
            F.length(norm).cast("long").alias("norm"),
            F.xxhash64("text").alias("text_hash"),
        ),
        "exact-rows",
    )


def groups(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``keep_digest, keep_id, keep_row, group_size`` of every different text among ``measured`` rows."""
    spark = rows.sparkSession
    shards = shuffle_partitions(spark)
    # A column of ids with a null among them would reach pandas as floating point.
    ids = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("known_id")
    runs = rows.select("run", *ids, "digest", "points", "norm", "row").mapInPandas(_first_runs(shards), _RUN)
    last = rows.agg(F.max("run")).first()[0] or 0
    rounds = max(1, math.ceil(math.log(last + 1, fan_in) - 1e-9))
    for i in range(rounds):
        dealt = (
            runs.withColumn("run", F.expr(f"run div {fan_in}"))
            .repartition(shards, "shard", "run")
            .sortWithinPartitions("shard", "run", "first")
        )
        runs = dealt.mapInPandas(_merge, _RUN) if i + 1 < rounds else dealt.mapInPandas(_decided, _KEPT)
    return runs.select(
        "keep_digest", F.when(~F.col("keep_null"), F.col("keep_id")).alias("keep_id"), "keep_row", "group_size"
    )


def decisions(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = measured(docs)
    return rows.join(groups(rows), F.col("digest") == F.col("keep_digest")).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    rows = measured(docs)
    told = rows.join(groups(rows), F.col("digest") == F.col("keep_digest"))
    return staying(docs, told.select("doc_id", "text_hash", (F.col("row") == F.col("keep_row")).alias("stays")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), n AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) = 1 AS kept
  FROM d
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM n
"""
