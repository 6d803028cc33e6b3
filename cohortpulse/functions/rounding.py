"""Rounding that does not depend on the order in which partitions are added up.

The two exact forms take integer sums and counts and work in integer arithmetic, so a rate is the same
number on any cluster layout. They expect non-negative input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def exact_pct(n: Column, d: Column) -> Column:
    """100 * n / d, half up to two digits; null if d is 0 or null."""
    return _div(20000 * n + d, 2 * F.nullif(d, F.lit(0))) / F.lit(100.0)


def exact_avg(total: Column, n: Column) -> Column:
    """total / n, half up to two digits; null if n is 0 or null."""
    return _div(200 * total + n, 2 * F.nullif(n, F.lit(0))) / F.lit(100.0)


def half_even(x: Column, digits: int = 2) -> Column:
    """Half to even on the scaled double, the rule of numpy's round."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale
