"""Questions over several facts of one entity without joining the facts to each other.

Joining facts A and B of an entity on its key gives nA * nB rows. Whatever is then summed can be computed from
one row per entity: a sum over A is inflated by nB, a mean or a ratio within A is not inflated at all.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.operators.aggregate import one


EXACT = "decimal(38,0)"

Facts = Mapping[str, tuple[DataFrame, Mapping[str, Column]]]


def _addends(key: str, facts: Facts) -> list[DataFrame]:
    return [
        df.select(key, one().alias(f"n_{name}"), *(c.cast("bigint").alias(m) for m, c in measures.items()))
        for name, (df, measures) in facts.items()
    ]


def _sums(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(*(F.sum(c).alias(c) for c in rows.columns if c != key))


def join_profile(entities: DataFrame, key: str, facts: Facts) -> DataFrame:
    """``entities`` with the sums of each fact, one row per entity row.

    ``facts`` maps a fact's name to its table and its measures (name -> numeric column, null = no addend). Each
    measure becomes a column with the sum, null if the entity has none, and ``n_<fact>`` holds the fact's rows.

    Every fact is summed per key and left-joined on the same key, so all joins share one partitioning: a fact is
    shuffled once, as partial sums, in which a hot key is one row per task. The optimizer drops the join to a
    fact none of whose columns is asked for, and with it the scan of that fact.
    """
    return reduce(lambda a, rows: a.join(_sums(rows, key), key, "left"), _addends(key, facts), entities)


def fact_profile(key: str, facts: Facts) -> DataFrame:
    """The sums of :func:`join_profile` for every key that occurs in any fact, known as an entity or not.

    The facts are stacked and summed in one aggregation, so there is one shuffle for all of them and no join.
    """
    return _sums(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _addends(key, facts)), key)


def multiplicity(rows: Column) -> Column:
    """Rows an outer-joined fact contributes to the product: a missing fact counts as one row."""
    return F.coalesce(rows, one())


def product(*factors: Column) -> Column:
    """Product of counts as ``decimal(38,0)``; beyond 38 digits the query fails instead of giving null."""

    def times(a: Column, b: Column) -> Column:
        exact = F.try_multiply(a, b.cast("decimal(20,0)")).cast(EXACT)
        known = a.isNotNull() & b.isNotNull()
        return F.when(known & exact.isNull(), F.raise_error(F.lit("a product of counts exceeds 38 digits"))).otherwise(exact)

    return reduce(times, factors[1:], factors[0].cast("decimal(20,0)")).cast(EXACT)


def as_bigint(count: Column) -> Column:
    """A count of ``product`` for output; beyond 64 bits the query fails instead of giving null."""
    too_large = F.raise_error(F.concat(F.lit("a count exceeds 64 bits: "), count.cast("string")))
    return F.when(count > F.lit(2**63 - 1), too_large).otherwise(count.try_cast("bigint"))
