"""Exact group medians over data of any size, and filling gaps with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size parameter of the sketch that brackets the middle, and the share of ranks taken on either side of it: several times
#: the sketch's usual rank error. Both change cost, not results.
SKETCH, MARGIN = 2048, 0.005


def _known(c: Column) -> Column:
    """Neither null nor not-a-number."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def group_median(df: DataFrame, group: str, value: str, sketch: int = SKETCH, margin: float = MARGIN) -> DataFrame:
    """(group, median) over the values that are numbers, the mean of the middle two where their number is even.

    The input is read once, by one aggregation: each value is counted under its group and itself (a hot group spreads over
    its values), and enters a mergeable quantile sketch under its group alone. The sketch brackets the middle of the group
    between two values, the rows below the bracket are counted exactly, and only the values inside it, about
    ``2 * margin`` of the group, are put in order. Should the exact counts say that the middle is not inside, the whole
    group is ordered. No hash map or sort of a whole group in one task, whatever the range of the values.
    """
    values = df.select(F.col(group).alias("g"), F.col(value).alias("v")).where(F.col("g").isNotNull() & _known(F.col("v")))
    no_value = F.lit(None).cast(values.schema["v"].dataType)
    number = F.col("v").cast("double")
    twice = F.explode(
        F.array(
            F.struct(F.col("v").alias("v"), F.lit(None).cast("double").alias("sketched")),
            F.struct(no_value.alias("v"), number.alias("sketched")),
        )
    )
    counted = (
        values.select("g", twice.alias("t"))
        .groupBy("g", F.col("t.v").alias("v"))
        .agg(
            F.count("*").alias("n"),
            F.count("t.sketched").alias("sketched"),
            F.kll_sketch_agg_double("t.sketched", F.lit(sketch)).alias("sketch"),
        )
    )
    # Both parts ask for the same aggregates and are told apart by one of them: so they share its exchange.
    ranks = F.array(F.lit(max(0.0, 0.5 - margin)), F.lit(min(1.0, 0.5 + margin)))
    # "lower" and "upper": 0-based ranks of the middle values, equal for an odd size
    brackets = (
        counted.where("sketched > 0")
        .select("g", "n", F.kll_sketch_get_quantile_double("sketch", ranks).alias("b"))
        .selectExpr("g AS bg", "b[0] AS low", "b[1] AS high", "(n - 1) div 2 AS lower", "n div 2 AS upper")
    )
    counts = counted.where("sketched = 0").select("g", "v", F.when(F.length("sketch") >= 0, F.col("n")).alias("n"))
    placed = counts.join(brackets, F.col("g") == F.col("bg")).drop("bg")
    below = F.coalesce(F.sum(F.when(F.col("v") < F.col("low"), F.col("n"))), F.lit(0))
    through = F.coalesce(F.sum(F.when(F.col("v") <= F.col("high"), F.col("n"))), F.lit(0))
    middle = (
        placed.groupBy("g", "low", "high", "lower", "upper")
        .agg(below.alias("below"), through.alias("through"))
        .selectExpr("g AS mg", "below", "lower >= below AND upper < through AS inside")
    )
    ordered = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(middle, F.col("g") == F.col("mg"))
        .where("NOT inside OR v BETWEEN low AND high")
        .withColumn("end", F.when(F.col("inside"), F.col("below")).otherwise(0) + F.sum("n").over(ordered))
        .withColumn("start", F.col("end") - F.col("n"))
        .groupBy("g")
        .agg(
            F.max(F.expr("CASE WHEN lower >= start AND lower < end THEN v END")).alias("first"),
            F.max(F.expr("CASE WHEN upper >= start AND upper < end THEN v END")).alias("second"),
        )
        .select(F.col("g").alias(group), ((F.col("first") + F.col("second")) / 2).alias("median"))
    )


def fill_with_group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """``value`` with its gaps, not-a-number included, filled by the median of its group; null wherever the group is null.

    Rows that need no filling pass by; only the others meet the medians, in a join whose strategy adaptive execution
    chooses from the sizes it finds. Nothing runs before the result is asked for.
    """
    fill = f"{value} of {group}"
    medians = group_median(df, group, value).withColumnRenamed("median", fill)
    gap = ~_known(F.col(value)) & F.col(group).isNotNull()
    whole = df.where(~gap).withColumn(value, F.when(F.col(group).isNotNull(), F.col(value)))
    filled = df.where(gap).join(medians, group, "left").withColumn(value, F.col(fill)).select(*df.columns)
    return whole.unionByName(filled)
