"""One feature row per student."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions import ENTITY_BANDS, band, half_even
from cohortpulse.operators.aggregate import flag
from cohortpulse.operators.fanout import Facts, fact_profile, join_profile
from cohortpulse.plans.labels import RiskRule
from cohortpulse.sources.schemas import KEY
from cohortpulse.sources.tables import Tables

ATTENDANCE_RATE = "Attendance_Rate_%"


def summary_facts(clean: Tables) -> Facts:
    """The facts of the summary and what it sums of them."""
    score = F.col("Exam_Score")
    return {
        "attendance": (clean["attendance"], {"present": flag(F.col("Attendance_Status") == "Present")}),
        "homework": (
            clean["homework"],
            {"done": flag(F.col("Status") == "Done"), "missed": flag(F.col("Status") == "Not Done")},
        ),
        "performance": (clean["parsed_performance"], {"score_sum": score, "scores": flag(score.isNotNull())}),
        "communication": (clean["communication"], {}),
    }


def student_profile(clean: Tables, without: tuple[str, ...] = ()) -> DataFrame:
    """Sums per student id over the four clean facts, or all but some, ids unknown to the students table included."""
    return fact_profile(KEY, {name: fact for name, fact in summary_facts(clean).items() if name not in without})


def is_at_risk(attendance: Column, score: Column, missed: Column, rule: RiskRule = RiskRule()) -> Column:
    """All three conditions; a missing operand makes it False, never unknown."""
    return F.coalesce(
        (attendance < rule.attendance) & (score < rule.score) & (missed > rule.missed), F.lit(False)
    )


def with_features(profiled: DataFrame, rule: RiskRule = RiskRule()) -> DataFrame:
    """Adds the feature columns to rows that carry the sums of :func:`student_profile`."""
    return (
        profiled.withColumns(
            {
                ATTENDANCE_RATE: half_even(F.col("present") / F.nullif(F.col("n_attendance"), F.lit(0)) * 100),
                "HW_Completion_%": half_even(F.col("done") / F.nullif(F.col("n_homework"), F.lit(0)) * 100),
                "Avg_Exam_Score": half_even(F.col("score_sum") / F.nullif(F.col("scores"), F.lit(0))),
                "Missed_Assignments": F.coalesce("missed", F.lit(0)),
                "Comm_Count": F.coalesce("n_communication", F.lit(0)),
            }
        )
        .withColumn("Has_Communication", F.col("Comm_Count") > 0)
        .withColumn(
            "Is_At_Risk",
            is_at_risk(F.col(ATTENDANCE_RATE), F.col("Avg_Exam_Score"), F.col("Missed_Assignments"), rule),
        )
        .withColumn("Score_Band", band(F.col("Avg_Exam_Score"), ENTITY_BANDS))
    )


def student_summary(clean: Tables, rule: RiskRule = RiskRule()) -> DataFrame:
    """All features of each student. Selecting some of them leaves the facts of the others unread."""
    profiled = join_profile(clean["students"], KEY, summary_facts(clean))
    return with_features(profiled, rule).select(
        KEY,
        "Full_Name",
        "Grade_Level",
        "Grade_Num",
        "Age",
        ATTENDANCE_RATE,
        "HW_Completion_%",
        "Avg_Exam_Score",
        "Missed_Assignments",
        "Comm_Count",
        "Has_Communication",
        "Is_At_Risk",
        "Score_Band",
    )


def at_risk(clean: Tables, rule: RiskRule = RiskRule()) -> DataFrame:
    return student_summary(clean, rule).filter("Is_At_Risk")
