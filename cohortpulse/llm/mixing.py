"""Mixing sources to target weights, with DataFrame functions only.

A source's rate is its target divided by its size. Each of its documents is taken ``floor(rate)`` times and once more
with a probability of the fraction, decided by a seeded hash of its ``doc_id``, so that reruns agree and no state is kept.
Of ``SEEDS`` seeds a source uses the one whose draw comes nearest to its target, which matters for sources of few or very
unequal documents.

Cases: a null or empty text has size 0 and is copied like any other; a null source is a source; a null ``doc_id`` is
hashed as an empty text; repeated rows are decided alike; an empty table gives an empty result; columns of other names
are neither read nor touched, and helper columns take names that the input does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortpulse.llm.common import documents, fresh, word_count
from cohortpulse.sources.scratch import written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
SEEDS = 16
#: Hexadecimal digits of a hash that make a chance: 52 bits.
_DIGITS = 13
_EXACT = "decimal(38,0)"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target, rate`` from ``source, size`` (one row per source).

    Weights are dealt to the sources in code point order, null last, repeating. All sizes together are shared by weight;
    no target passes ``most`` times its source's size, and what is over goes to the others by weight. Sorted by the share
    at which a source is full, the full ones are a prefix, found by comparing exact integers. One row per source is
    gathered here, never one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    full = (F.col("size") * most).cast(_EXACT)
    ranked = sizes.select(
        "source", "size", full.alias("full"), F.row_number().over(by_name).alias("place")
    ).withColumn("weight", F.element_at(cycle, (F.col("place") - 1) % len(weights) + 1).cast(_EXACT))
    fills = Window.orderBy(F.col("full").cast("double") / F.col("weight").cast("double"), "place")
    before, everything = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast(_EXACT)
    shares = ranked.select(
        "*",
        F.sum("size").over(everything).cast(_EXACT).alias("total"),
        F.sum("weight").over(everything).cast(_EXACT).alias("weights"),
        F.coalesce(F.sum("full").over(before).cast(_EXACT), zero).alias("full_before"),
        F.coalesce(F.sum("weight").over(before).cast(_EXACT), zero).alias("weight_before"),
    ).withColumn(
        "is_full",
        F.col("full") * (F.col("weights") - F.col("weight_before"))
        <= F.col("weight") * (F.col("total") - F.col("full_before")),
    )
    held = F.sum(F.when(F.col("is_full"), F.col("full")).otherwise(zero)).over(everything).cast(_EXACT)
    open_weight = F.sum(F.when(~F.col("is_full"), F.col("weight")).otherwise(zero)).over(everything).cast(_EXACT)
    shared = (F.col("weight") * (F.col("total") - held)).cast("double") / open_weight.cast("double")
    target = F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(shared)
    return shares.select("source", F.col("size").alias("source_size"), target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def chance(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) that depends on the id and the seed (0 to ``SEEDS - 1``) only: digits of one hash."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{SEED}"))
    digits = F.substr(F.md5(key), seed + 1, F.lit(_DIGITS))
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 4 * _DIGITS))


def copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return whole + F.when(chance(doc_id, seed) < rate - whole, 1).otherwise(0)


def _measured(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def _rated(measured: DataFrame, rates: DataFrame) -> DataFrame:
    return measured.join(rates.withColumnRenamed("source", "rated"), F.col("source").eqNullSafe(F.col("rated")))


def rates(measured: DataFrame) -> DataFrame:
    """``source, source_size, target, rate, seed`` of ``doc_id, source, size``.

    Written, so that the planner knows their size: they are broadcast only below the session's threshold.
    """
    found = written(targets(measured.groupBy("source").agg(F.sum("size").alias("size"))), "mix-targets")
    draws = [
        F.sum(F.col("size") * copies(F.col("doc_id"), F.col("rate"), F.lit(k))).alias(f"draw_{k}") for k in range(SEEDS)
    ]
    drawn = _rated(measured, found).groupBy("source").agg(F.max("target").alias("wanted"), *draws)
    misses = [F.struct(F.abs(F.col(f"draw_{k}") - F.col("wanted")).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    seeds = drawn.select("source", F.array_min(F.array(*misses))["seed"].alias("seed"))
    seeds = seeds.withColumnRenamed("source", "drawn")
    joined = found.join(seeds, F.col("source").eqNullSafe(F.col("drawn"))).drop("drawn")
    return written(joined, "mix-rates")


def plan(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source_size, target, copies, taken``."""
    measured = _measured(docs)
    return (
        _rated(measured, rates(measured))
        .withColumn("copies", copies(F.col("doc_id"), F.col("rate"), F.col("seed")))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken, with its columns."""
    rated, rate, seed, copy = (fresh(docs, name) for name in ("mix_source", "mix_rate", "mix_seed", "mix_copy"))
    found = rates(_measured(docs))
    found = found.select(F.col("source").alias(rated), F.col("rate").alias(rate), F.col("seed").alias(seed))
    taken = docs.join(found, docs["source"].eqNullSafe(F.col(rated)))
    times = copies(docs["doc_id"], F.col(rate), F.col(seed)).cast("int")
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*[docs[c] for c in docs.columns])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::HUGEINT AS weight, 3 * size AS full_size FROM s
), c AS (
  SELECT *, sum(size) OVER ()::HUGEINT AS total, sum(weight) OVER ()::HUGEINT AS weights,
    coalesce(sum(full_size) OVER f, 0)::HUGEINT AS full_before,
    coalesce(sum(weight) OVER f, 0)::HUGEINT AS weight_before
  FROM w
  WINDOW f AS (ORDER BY full_size::DOUBLE / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT *, full_size * (weights - weight_before) <= weight * (total - full_before) AS is_full FROM c
), t AS (
  SELECT source, size::BIGINT AS source_size, CASE WHEN is_full THEN full_size::DOUBLE ELSE
    (weight * (total - sum(CASE WHEN is_full THEN full_size ELSE 0 END) OVER ()::HUGEINT))::DOUBLE
    / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM e
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), h AS (
  SELECT doc_id, d.source, size, source_size, target, rate,
    md5(coalesce(doc_id::VARCHAR, '') || '|mix-1') AS digits
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), k AS (
  SELECT h.*, seed, (floor(rate) + CASE WHEN
    ('0x' || substr(digits, seed + 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END
  )::BIGINT AS copies
  FROM h, (SELECT unnest(range(16))::INT AS seed)
), m AS (
  SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - max(target)), seed) AS best
  FROM k GROUP BY source, seed
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken
FROM k JOIN m ON k.source IS NOT DISTINCT FROM m.source AND k.seed = m.seed AND best = 1
"""
