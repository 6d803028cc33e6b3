"""spark-submit entry: ``python -m cohortpulse RAW_DIR OUT_DIR --as-of YYYY-MM-DD``."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from cohortpulse.plans.pipeline import run
from cohortpulse.sources.files import NA_VALUES


def main() -> None:
    parser = argparse.ArgumentParser(prog="cohortpulse")
    parser.add_argument("raw", help="folder with the five raw CSVs")
    parser.add_argument("out", help="folder for the clean tables")
    parser.add_argument("--as-of", type=date.fromisoformat, required=True, help="day for which ages are computed")
    parser.add_argument("--multiline", action="store_true", help="quoted fields may hold line ends")
    parser.add_argument("--na", action="append", help="a text that stands for missing, instead of the usual ones; repeatable")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("cohortpulse").getOrCreate()
    run(spark, args.raw, args.out, args.as_of, multiline=args.multiline, na_values=NA_VALUES if args.na is None else args.na)
    spark.stop()


if __name__ == "__main__":
    main()
