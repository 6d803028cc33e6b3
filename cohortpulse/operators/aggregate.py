"""Counts, rates and shares by group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortpulse.functions import exact_pct


def share_of_total(
    df: DataFrame, key: str | Column, count: str = "Count", share: str = "Pct"
) -> DataFrame:
    """Rows per group and each group's percentage of all rows.

    The total is a scalar subquery over the same aggregation. Its plan reuses the aggregation's exchange, so
    the input is read once, and however many groups there are, only one partial sum per task is brought
    together. (A window without partitions would move every group into one task.)
    """
    groups = df.groupBy(key).agg(F.count("*").alias(count))
    total = groups.agg(F.sum(count)).scalar()
    return groups.withColumn(share, exact_pct(F.col(count), total))


def count_where(df: DataFrame, by: Sequence[str | Column], total: str, **conditions: Column) -> DataFrame:
    """Rows per group (``total``) and, per name, the rows for which the condition holds.

    No group columns gives one row for the whole table.
    """
    return df.groupBy(*by).agg(
        F.count("*").alias(total), *(F.count_if(c).alias(name) for name, c in conditions.items())
    )


def collapse_copies(df: DataFrame, *columns: str) -> DataFrame:
    """Each combination of ``columns`` once, with the number of its rows in ``copies``."""
    return df.groupBy(*columns).agg(F.count("*").alias("copies"))


def sums_by_attribute(
    fact: DataFrame,
    entities: DataFrame,
    key: str,
    by: Sequence[str],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Sums of numeric ``measures`` of a fact by columns of its entity (inner join on ``key``).

    The fact is summed per key and equal entity rows are collapsed before the join: raw rows are never shuffled,
    a hot key is one row per task on either side, and the join sees one fact row per key.
    """
    per_key = fact.groupBy(key).agg(*(F.sum(m).alias(n) for n, m in measures.items()))
    joined = per_key.join(collapse_copies(entities, key, *by), key)
    return joined.groupBy(*by).agg(*(F.sum(F.col(n) * F.col("copies")).alias(n) for n in measures))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(column, label, n) of the non-null values of several columns, in one pass over the table."""
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns))
    return (
        df.select(F.inline(entries))
        .filter(F.col("label").isNotNull())
        .groupBy("column", "label")
        .agg(F.count("*").alias("n"))
    )


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, as a 64-bit number ready for summing."""
    return F.when(condition, 1).otherwise(0).cast(T.LongType())


def one() -> Column:
    """The number a row adds to a count."""
    return F.lit(1).cast(T.LongType())
