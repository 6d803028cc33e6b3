"""Shape, nulls and references of tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def shape_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, columns), one row per table."""
    return _stack(
        [
            df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
            )
            for name, df in tables.items()
        ]
    )


def counts_report(tables: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """(table, rows, columns, column, nulls): per table and name, the rows that meet a condition.

    All conditions of a table are counted in one pass over it, so the width of the report does not add scans.
    """
    parts = []
    for name, (df, conditions) in tables.items():
        counted = df.agg(
            F.count("*").alias("rows"), *(F.count_if(p).alias(f"c{i}") for i, p in enumerate(conditions.values()))
        )
        entries = [
            F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(conditions)
        ]
        size = F.lit(len(df.columns)).cast("bigint").alias("columns")
        parts.append(counted.select(F.lit(name).alias("table"), "rows", size, F.inline(F.array(*entries))))
    return _stack(parts)


def null_conditions(df: DataFrame) -> dict[str, Column]:
    return {c: quoted(c).isNull() for c in df.columns}


def orphan_counts(entities: DataFrame, key: str, facts: Mapping[str, DataFrame]) -> DataFrame:
    """(table, orphans): distinct fact keys, a null one included, that no entity has.

    The keys of all facts are made distinct together and joined once; an entity table too large to broadcast is read once. A fact
    without orphans, or without rows, is reported with 0.
    """
    names = list(facts)
    seen = _stack(
        [df.select(key, *(F.lit(name == other).alias(other) for other in names)) for name, df in facts.items()]
    )
    keys = seen.groupBy(key).agg(*(F.max(n).alias(n) for n in names))
    lost = keys.join(entities.select(key).distinct(), key, "left_anti")
    return lost.agg(
        F.array(
            *(F.struct(F.lit(n).alias("table"), F.count_if(F.col(n)).alias("orphans")) for n in names)
        ).alias("found")
    ).select(F.inline("found"))


def contents_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, columns, filled): as :func:`shape_report`, with the number of non-null values."""
    parts = []
    for name, df in tables.items():
        filled = reduce(Column.__add__, [F.count(quoted(c)) for c in df.columns])
        parts.append(
            df.agg(F.count("*").alias("rows"), filled.alias("filled")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "filled"
            )
        )
    return _stack(parts)
