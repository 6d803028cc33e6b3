"""Raw CSVs to clean outputs, end to end."""

from __future__ import annotations

from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cohortpulse.plans.clean import clean_tables
from cohortpulse.plans.features import student_summary
from cohortpulse.sources.files import bronze_tables, read_clean_csv, write_bucketed, write_csv, write_parquet
from cohortpulse.sources.published import all_at_once, publish, published_paths
from cohortpulse.sources.schemas import EXPORTED, KEY, SILVER
from cohortpulse.sources.tables import Tables

# Facts that dashboards read by month; the others have no month column.
BY_MONTH = {"attendance": ("Month",), "communication": ("Month",)}


def _stored_as(name: str) -> str:
    """Stored performance rows carry the filled rate; whoever asks for the parsed ones uses other columns."""
    return "performance" if name == "parsed_performance" else name


def with_summary(clean: Tables) -> Tables:
    """The clean tables and ``student_summary``."""
    return Tables(lambda name: student_summary(clean) if name == "student_summary" else clean[name])


def write_silver(clean: Tables, root: str) -> Tables:
    """Writes the five clean tables as Parquet below ``root`` and returns them read back from there.

    What follows then scans columns of typed files instead of parsing and cleaning text again.
    """
    all_at_once(
        [partial(write_parquet, clean[name], f"{root}/{name}", BY_MONTH.get(name, ())) for name in SILVER]
    )
    spark = clean["students"].sparkSession

    def reopen(name: str) -> DataFrame:
        stored = _stored_as(name)
        found = spark.read.schema(SILVER[stored]).parquet(f"{root}/{stored}")
        return found.select(*clean[stored].columns)

    return Tables(reopen)


def write_by_student(clean: Tables, root: str, buckets: int, prefix: str) -> Tables:
    """The five clean tables as catalog tables ``<prefix><name>`` below ``root``, in ``buckets`` buckets by student.

    Sums per student and joins of such sums then take place where the rows lie, without a shuffle. A fact of which one
    student holds more than a few buckets' worth is stored unbucketed: its bucket would be read by one task, while a sum
    per student shuffles one row per task and student only.
    """
    all_at_once(
        [partial(write_bucketed, clean[name], f"{prefix}{name}", KEY, buckets, f"{root}/{name}") for name in SILVER]
    )
    spark = clean["students"].sparkSession
    return Tables(lambda name: spark.table(f"{prefix}{_stored_as(name)}").select(*clean[name].columns))


def export_csv(tables: Tables, root: str) -> str:
    """The five dashboard inputs as CSV folders below ``root``, published together; see :func:`exported`."""
    return publish({name: tables[name] for name in EXPORTED}, root, write_csv, ".csv")


def exported(spark: SparkSession, root: str) -> Tables:
    """The typed tables of the last complete export below ``root``."""
    paths = published_paths(spark, root)
    return Tables(lambda name: read_clean_csv(spark, paths[name], name))


def run(spark: SparkSession, raw_root: str, out_root: str, as_of: date, **csv_options) -> Tables:
    """CSVs under ``raw_root`` -> Parquet under ``out_root/silver`` -> CSVs published under ``out_root``."""
    clean = clean_tables(bronze_tables(spark, raw_root, **csv_options), as_of)
    silver = with_summary(write_silver(clean, f"{out_root}/silver"))
    write_parquet(silver["student_summary"], f"{out_root}/silver/student_summary")
    export_csv(silver, out_root)
    return silver
