"""Shape of the physical plans."""

import re

import pytest

from cohortpulse.operators.median import group_median
from cohortpulse.plans.features import student_summary
from cohortpulse.plans.pipeline import write_by_student
from cohortpulse.plans.registry import QUERIES, clean_of
from cohortpulse.sources.schemas import SILVER
from tests.helpers import final_plan, first_plan, rows

# Queries that write files first; their plans only read them back.
WRITING = {"csv_scan_homework", "export_clean"}


@pytest.fixture()
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_python_and_no_product_joins(spark, sf_dir, name):
    plan = first_plan(QUERIES[name](spark, sf_dir))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInArrow"):
        assert word not in plan


def test_top_n_does_not_sort_everything(spark, sf_dir):
    for name in ("top10_students", "bottom10_students", "top5_contacted"):
        assert "TakeOrderedAndProject" in first_plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["grade_distribution", "homework_status_landscape", "message_type_split"])
def test_shares_reuse_their_aggregation(spark, sf_dir, name):
    assert "ReusedExchange" in final_plan(QUERIES[name](spark, sf_dir))


def test_summary_shuffles_each_table_once(spark, sf_dir, no_broadcast):
    plan = first_plan(QUERIES["student_summary"](spark, sf_dir))
    # students and four facts by student; the other two shuffles join the derived attendance
    assert len(re.findall(r"Exchange hashpartitioning\(Student_ID", plan)) == 5
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 7


@pytest.mark.parametrize(
    "name, files",
    [
        ("student_score_bands", {"customer", "orders"}),
        ("avg_attendance_rate_by_grade", {"customer", "orders", "lineitem"}),
        ("at_risk_by_grade", {"customer", "orders", "lineitem"}),
        ("student_summary", {"customer", "orders", "lineitem", "events"}),
    ],
)
def test_facts_nobody_asks_for_are_not_read(spark, sf_dir, name, files):
    plan = first_plan(QUERIES[name](spark, sf_dir))
    assert set(re.findall(r"(\w+)\.parquet\]", plan)) == files
    if name == "student_score_bands":
        assert plan.count("FileScan") == 2


def test_executive_stacks_the_facts(spark, sf_dir, no_broadcast):
    plan = first_plan(QUERIES["kpi_executive"](spark, sf_dir))
    # the stacked facts and the students; the other two shuffles join the derived attendance
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4


def test_entity_rollup_shuffles_sums_not_rows(spark, sf_dir, no_broadcast):
    plan = first_plan(QUERIES["pending_rate_by_grade"](spark, sf_dir))
    exchange = plan.index("Exchange hashpartitioning(Student_ID")
    assert plan.index("partial_sum", exchange) > exchange


def test_fanout_never_joins_facts(spark, sf_dir, no_broadcast):
    plan = first_plan(QUERIES["at_risk_fanout"](spark, sf_dir))
    # one join builds the derived attendance, four bring per-student sums to the students
    assert plan.count("SortMergeJoin") == 5
    assert plan.count("LeftOuter") + plan.count("Inner") == 5


def test_median_fill_leaves_the_fact_unshuffled(spark, sf_dir):
    plan = first_plan(QUERIES["clean_performance"](spark, sf_dir))
    union = plan.index("Union")
    filled = plan.index("Join", union)
    # the branch of the rows that need no filling is a scan
    assert "Exchange" not in plan[union:filled] and "FileScan" in plan[union:filled]


def test_executive_reads_no_messages(spark, sf_dir):
    assert "events.parquet" not in first_plan(QUERIES["kpi_executive"](spark, sf_dir))


def test_counting_rows_computes_no_medians(spark, sf_dir):
    plan = first_plan(QUERIES["clean_shapes"](spark, sf_dir))
    assert "kll_sketch" not in plan and plan.count("FileScan") <= 7


def test_quality_report_reads_facts_once(spark, sf_dir):
    plan = first_plan(QUERIES["quality_report"](spark, sf_dir))
    # students, attendance (a join of two files), homework, messages, and performance twice
    assert plan.count("FileScan") == 7


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = first_plan(QUERIES["feedback_distribution"](spark, sf_dir))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"o_orderkey:bigint"}
    plan = first_plan(QUERIES["kpi_scores"](spark, sf_dir))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"o_totalprice:double"}


def test_median_reads_and_counts_values_once(spark, sf_dir):
    parsed = clean_of(spark, sf_dir)["parsed_performance"]
    plan = final_plan(group_median(parsed, "Subject", "CompletionRate"))
    assert "ReusedExchange" in plan and plan.count("FileScan") == 1
    # the filled table: its rows with a rate, its rows without, and the medians
    assert final_plan(clean_of(spark, sf_dir)["performance"]).count("FileScan") == 3


def test_tables_stored_by_student_are_summed_and_joined_where_they_lie(spark, sf_dir, tmp_path, no_broadcast):
    clean = clean_of(spark, sf_dir)
    stored = write_by_student(clean, str(tmp_path / "by_student"), 8, "by_student_")
    found = student_summary(stored)
    assert "hashpartitioning(Student_ID" not in first_plan(found) and "SortMergeJoin" in first_plan(found)
    assert sorted(rows(found), key=str) == sorted(rows(student_summary(clean)), key=str)
    assert "Exchange" not in first_plan(found).split("SortMergeJoin", 1)[1]
    for name in SILVER:
        spark.sql(f"DROP TABLE by_student_{name}")
