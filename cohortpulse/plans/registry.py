"""All queries by name, run over the tables derived from a folder of Parquet files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cohortpulse.operators.quality import contents_report
from cohortpulse.plans import audit, clean, dashboard, features, story
from cohortpulse.plans.pipeline import export_csv, exported, with_summary, write_silver
from cohortpulse.sources.files import read_bronze_csv, write_csv
from cohortpulse.sources.fixtures import derived_tables
from cohortpulse.sources.schemas import EXPORTED
from cohortpulse.sources.scratch import scratch_path
from cohortpulse.sources.tables import Tables

AS_OF = date(2025, 3, 31)

Query = Callable[[SparkSession, str], DataFrame]


def _named(*plans: Callable[..., DataFrame]) -> dict[str, Callable[..., DataFrame]]:
    return {plan.__name__: plan for plan in plans}


# Over raw tables with stripped keys.
STORY = _named(
    story.grade_distribution,
    story.attendance_status_landscape,
    story.attendance_rate_by_grade,
    story.attendance_by_subject,
    story.late_rate_by_subject,
    story.monthly_attendance_trend,
    story.homework_status_landscape,
    story.homework_completion_by_subject,
    story.completion_by_signature,
    story.feedback_distribution,
    story.pending_rate_by_grade,
    story.score_band_distribution,
    story.score_by_subject,
    story.score_by_grade,
    story.top10_students,
    story.bottom10_students,
    story.message_type_split,
    story.monthly_message_volume,
    story.contact_vs_score,
    story.contact_coverage_by_grade,
    story.top5_contacted,
    story.contacted_but_failing,
    story.at_risk_fanout,
) | {"age_spread_iso": lambda raw: story.age_spread_iso(raw, AS_OF)}

# Over clean tables.
CLEANING = {f"clean_{name}": lambda tables, name=name: tables[name] for name in audit.CLEAN}
FEATURES = _named(features.student_summary, features.at_risk)
AUDIT = _named(
    audit.orphan_check,
    audit.preview_students,
    audit.preview_communication,
    audit.preview_summary,
    audit.clean_shapes,
    audit.status_value_counts,
    audit.completion_rate_by_subject,
)
DASHBOARD = _named(
    dashboard.kpi_executive,
    dashboard.student_score_bands,
    dashboard.at_risk_by_grade,
    dashboard.monthly_attendance,
    dashboard.kpi_attendance,
    dashboard.absence_tardiness_by_subject,
    dashboard.status_by_subject,
    dashboard.avg_attendance_rate_by_grade,
    dashboard.kpi_homework,
    dashboard.completion_donut,
    dashboard.completion_rate_by_subject_clean,
    dashboard.kpi_scores,
    dashboard.score_by_subject_grade,
    dashboard.score_histogram,
    dashboard.kpi_contact,
    dashboard.silent_by_grade,
    dashboard.message_volume_trend,
    dashboard.at_risk_cohort_kpi,
    dashboard.risk_scatter,
    dashboard.at_risk_table,
)

# Over raw and clean tables.
BOTH = _named(audit.quality_report, audit.unmapped_counts)

# Over raw tables as they come.
RAW = {
    "raw_shapes": audit.raw_shapes,
    "clean_performance_negatives_null": lambda raw: clean.clean_performance(raw["performance"], negative="null"),
}


def queries_over(raw: Tables) -> dict[str, Callable[[], DataFrame]]:
    """Every query that writes no files, ready to be called, over any raw tables."""
    keyed, tables = story.with_stripped_keys(raw), clean.clean_tables(raw, AS_OF)
    return (
        {name: partial(plan, keyed) for name, plan in STORY.items()}
        | {name: partial(plan, tables) for name, plan in (CLEANING | FEATURES | AUDIT | DASHBOARD).items()}
        | {name: partial(plan, raw, tables) for name, plan in BOTH.items()}
        | {name: partial(plan, raw) for name, plan in RAW.items()}
    )


def _over_files(name: str) -> Query:
    return lambda spark, sf_dir: queries_over(derived_tables(spark, sf_dir))[name]()


def clean_of(spark: SparkSession, sf_dir: str) -> Tables:
    return clean.clean_tables(derived_tables(spark, sf_dir), AS_OF)


def csv_scan_homework(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw homework written as CSV and scanned again: padded texts, blanks and emoji survive."""
    path = scratch_path(spark, "csv-scan") + "/homework.csv"
    write_csv(derived_tables(spark, sf_dir)["homework"], path)
    return read_bronze_csv(spark, path, "homework", encoded=True)


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables addressed from SQL by name; the session's own views stay as they are."""
    keyed = story.with_stripped_keys(derived_tables(spark, sf_dir))
    return spark.sql(
        """
        SELECT s.Grade_Level, h.Subject, count(*) AS Assignments
        FROM {homework} h JOIN {students} s ON h.Student_ID = s.Student_ID
        GROUP BY s.Grade_Level, h.Subject
        ORDER BY s.Grade_Level, h.Subject
        """,
        homework=keyed["homework"],
        students=keyed["students"],
    )


def export_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the five dashboard CSVs and reports what a typed scan of them finds."""
    root = scratch_path(spark, "export")
    silver = write_silver(clean_of(spark, sf_dir), f"{root}/silver")  # cleaned once, for its file and for the summary
    export_csv(with_summary(silver), root)
    found = exported(spark, root)
    return contents_report({name: found[name] for name in EXPORTED})


QUERIES: dict[str, Query] = {
    name: _over_files(name) for name in (*STORY, *CLEANING, *FEATURES, *AUDIT, *DASHBOARD, *BOTH, *RAW)
} | _named(csv_scan_homework, table_scan, export_clean)
