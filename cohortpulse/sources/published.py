"""Several outputs published together: staged below a version, made current by one manifest.

``root/_versions/<version>/<name>.csv`` holds the outputs, ``root/_manifests/<version>`` one small JSON file that names them
with their rows and nulls, counted while they were written. The manifest is written last. Readers take the newest manifest,
so they see all outputs of one run or all of the run before; what a failed run left behind is never named.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortpulse.operators.quality import quoted

_MANIFEST = "version string, name string, path string, rows bigint, columns array<struct<column: string, nulls: bigint>>"


def all_at_once(jobs: Iterable[Callable[[], None]]) -> None:
    """Independent jobs submitted together: the last tasks of one do not leave the executors idle."""
    with ThreadPoolExecutor() as pool:
        for job in [pool.submit(job) for job in jobs]:
            job.result()


def observed(df: DataFrame) -> tuple[DataFrame, Callable[[], tuple[int, dict[str, int]]]]:
    """``df`` whose rows and nulls are counted as some action passes over it, and what gives the counts afterwards."""
    seen = Observation(f"columns of {uuid.uuid4().hex}")
    nulls = [F.count_if(quoted(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]
    columns = df.columns

    def counts() -> tuple[int, dict[str, int]]:
        found = seen.get
        return found["rows"], {c: found[f"c{i}"] for i, c in enumerate(columns)}

    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls), counts


def publish(outputs: Mapping[str, DataFrame], root: str, write: Callable[[DataFrame, str], None], suffix: str = "") -> str:
    """Writes all outputs at the same time and, when every one is complete, their manifest. Returns the version.

    ``outputs`` must share one session. If a write fails, the error is raised and the version before stays current.
    """
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    entries: dict[str, dict] = {}

    def one(name: str, df: DataFrame) -> Callable[[], None]:
        def job() -> None:
            path = f"{root}/_versions/{version}/{name}{suffix}"
            watched, counts = observed(df)
            write(watched, path)
            rows, nulls = counts()
            columns = [{"column": c, "nulls": n} for c, n in nulls.items()]
            entries[name] = {"version": version, "name": name, "path": path, "rows": rows, "columns": columns}

        return job

    all_at_once([one(name, df) for name, df in outputs.items()])
    spark = next(iter(outputs.values())).sparkSession
    lines = [(json.dumps(entries[name]),) for name in outputs]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{root}/_manifests/{version}")
    return version


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``version, name, path, rows, columns`` of the outputs that are current; no row before anything was published.

    Versions sort by time, so the current one is the last.
    """
    try:
        entries = spark.read.schema(_MANIFEST).json(f"{root}/_manifests/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)
    return entries.where(F.col("version") == entries.agg(F.max("version")).scalar())


def published_paths(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder of each output of the current version: all from one manifest, read once."""
    found = {r["name"]: r["path"] for r in manifest(spark, root).select("name", "path").collect()}
    if not found:
        raise FileNotFoundError(f"nothing was published below {root}")
    return found


def published_nulls(spark: SparkSession, root: str) -> DataFrame:
    """(table, rows, columns, column, nulls) of every column with nulls, as counted while the outputs were written."""
    return (
        manifest(spark, root)
        .select(F.col("name").alias("table"), "rows", F.size("columns").cast("bigint").alias("columns"), F.inline("columns"))
        .where("nulls > 0")
        .orderBy("table", "column")
    )
