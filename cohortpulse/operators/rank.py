"""Top n with a stable tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.operators.quality import quoted


def top_n(df: DataFrame, n: int, order: Column, tie_break: str) -> DataFrame:
    """The first n rows; ties are broken by ``tie_break``, then by all columns, so equal rows alone can swap.

    Spark keeps n rows per task and merges those; there is no full sort.
    """
    rest = [quoted(c).asc() for c in df.columns if c != tie_break]
    return df.orderBy(order, F.col(tie_break).asc(), *rest).limit(n)
