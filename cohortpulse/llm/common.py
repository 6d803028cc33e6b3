"""Helpers that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.sources.scratch import written

#: Words are runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words.
SPACES = " \t\n\x0b\x0c\r"

U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def staying(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay by ``decided``: ``doc_id, text_hash, stays`` of every row, where
    ``text_hash`` is ``xxhash64(text)``.

    Those that go are few: their keys are written and excluded, and where their files are small enough to be broadcast the
    texts are neither shuffled nor sorted. Repeated rows share a key; of those that stay one is taken.
    """
    keys = decided.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.max("stays").alias("stays"))
    keys = keys.where("NOT stays OR rows > 1").select(F.col("doc_id").alias("told_id"), F.col("text_hash").alias("told_hash"), "stays")
    keys = written(keys, "told-rows")
    own = fresh(docs, "hash_of_text")
    keyed = docs.withColumn(own, F.xxhash64("text"))
    same = (F.col(own) == F.col("told_hash")) & keyed["doc_id"].cast("long").eqNullSafe(F.col("told_id"))
    rest = keyed.join(keys, same, "left_anti")
    repeated = keyed.join(keys.where("stays"), same, "left_semi").dropDuplicates([own, "doc_id"])
    return rest.unionByName(repeated).drop(own)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def without_spaces(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def pieces(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items whose lengths add up to about ``most``; a longer item stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def text_pieces(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """``pieces`` of texts by their characters, before any of them becomes a Python string; null has none."""
    return pieces(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), most)
