"""Every registered query against DuckDB, and what must hold for any data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortpulse.oracle import oracle_queries
from cohortpulse.plans.registry import QUERIES
from tests.compare import differences, duckdb_views


@pytest.fixture(scope="session")
def duck(sf_dir):
    return duckdb_views(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_queries()) <= set(entry.queries())


def test_entry_is_the_summary(spark):
    result = entry.entry(spark)
    assert result.count() == 150 and result.columns[0] == "Student_ID" and len(result.columns) == 13


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_duckdb(spark, sf_dir, duck, name):
    assert differences(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name]) == []


def _run(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)


SHARES = {
    "grade_distribution": "Pct_of_School",
    "attendance_status_landscape": "Pct",
    "homework_status_landscape": "Pct",
    "feedback_distribution": "Pct",
    "score_band_distribution": "Pct",
    "message_type_split": "Pct",
    "completion_donut": "Pct",
}


@pytest.mark.parametrize("name", sorted(SHARES))
def test_shares_sum_to_100(spark, sf_dir, name):
    total = _run(spark, sf_dir, name).agg(F.sum(SHARES[name]).alias("x")).first().x
    assert abs(total - 100) <= 0.05


def test_summary_has_each_student_once(spark, sf_dir):
    summary = _run(spark, sf_dir, "student_summary")
    assert summary.count() == summary.select("Student_ID").distinct().count() == 150


def test_silent_and_contacted_are_all(spark, sf_dir):
    sums = _run(spark, sf_dir, "contact_coverage_by_grade").agg(
        F.sum("Total_Students"), F.sum("Students_With_Comms"), F.sum("Silent_Students")
    )
    total, contacted, silent = sums.first()
    assert total == contacted + silent == 150
    assert silent == _run(spark, sf_dir, "kpi_contact").first().Silent_Students == 135


def test_label_counts_and_nulls_are_all_rows(spark, sf_dir):
    counted = _run(spark, sf_dir, "status_value_counts").groupBy("table", "column").agg(F.sum("n").alias("n"))
    unmapped = _run(spark, sf_dir, "unmapped_counts").collect()
    nulls = {(r.table, r.column): r.nulls for r in unmapped}
    size = {r.table: r.rows for r in unmapped}
    for r in counted.collect():
        assert r.n + nulls.get((r.table, r.column), 0) == size[r.table]


@pytest.mark.parametrize(
    "name, columns",
    {
        "grade_distribution": [("Grade_Level", 1)],
        "attendance_status_landscape": [("Count", -1), ("Status", 1)],
        "attendance_rate_by_grade": [("Present_Rate_Pct", 1), ("Grade_Level", 1)],
        "late_rate_by_subject": [("Late_Rate_Pct", -1), ("Subject", 1)],
        "monthly_attendance_trend": [("Month", 1)],
        "score_by_subject": [("Avg_Score", 1)],
        "top10_students": [("Avg_Score", -1), ("Student_ID", 1)],
        "bottom10_students": [("Avg_Score", 1), ("Student_ID", 1)],
        "contact_coverage_by_grade": [("Silent_Pct", -1)],
        "contacted_but_failing": [("Communication_Count", -1), ("Avg_Exam_Score", 1), ("Student_ID", 1)],
        "at_risk_fanout": [("Avg_Exam_Score", 1), ("Attendance_Rate_Pct", 1)],
    }.items(),
)
def test_order_of_rows(spark, sf_dir, name, columns):
    found = _run(spark, sf_dir, name).collect()
    expected = found
    for column, sign in reversed(columns):
        expected = sorted(expected, key=lambda r: r[column], reverse=sign < 0)
    assert found == expected


def test_score_bands_are_ordered_by_score(spark, sf_dir):
    names = [r.Score_Band.split()[0] for r in _run(spark, sf_dir, "score_band_distribution").collect()]
    assert names == ["Failing", "Average", "Good", "Excellent", "High"]
