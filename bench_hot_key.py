"""

``python bench_hot_key.py [sf_dir]`` prints seconds for the attendance of the given folder, as it is and with a third of its
rows moved to one student, and the same for the median fill.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import functions as F

from cohortpulse.operators.aggregate import flag
from cohortpulse.operators.fanout import fact_profile
from cohortpulse.operators.median import fill_with_group_median
from cohortpulse.plans.registry import clean_of
from cohortpulse.session import local_session
from cohortpulse.sources.schemas import KEY


def seconds(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 2)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    tables = clean_of(spark, sf_dir)
    attendance = tables["attendance"].repartition(16).cache()
    performance = tables["parsed_performance"].repartition(16).cache()
    attendance.count(), performance.count()
    third = F.rand(7) < 1 / 3
    for label, moved in (("even", F.lit(False)), ("a third on one key", third)):
        rows = attendance.withColumn(KEY, F.when(moved, "S000001").otherwise(F.col(KEY)))
        scores = performance.withColumn("Subject", F.when(moved, "Math").otherwise(F.col("Subject")))
        profile = fact_profile(KEY, {"attendance": (rows, {"present": flag(F.col("Attendance_Status") == "Present")})})
        filled = fill_with_group_median(scores, "Subject", "CompletionRate")
        for name, df in (("sums per student", profile), ("median fill", filled)):
            seconds(df)
            print(f"{name}, {label}: {min(seconds(df) for _ in range(3))} s")
    spark.stop()


if __name__ == "__main__":
    main()
