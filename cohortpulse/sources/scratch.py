"""Shared folder for tables that a query writes on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder the cluster names in ``spark.checkpoint.dir``, else below its warehouse.

    Both are shared by all executors, and the choice does not depend on the master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/cohortpulse/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written once and read back: computed once, survives lost executors, and of known size.

    The planner then broadcasts it exactly if its files are below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
