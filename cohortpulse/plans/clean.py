"""Raw tables to clean tables. Every step is a projection, so cleaning adds no shuffle to what follows it;
only the medians that fill completion rates need passes of their own."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions import age_by_days, lookup, month_label, parse_mixed_date, percent_fraction, strip, whole_number
from cohortpulse.operators.median import fill_with_group_median
from cohortpulse.plans.labels import ATTENDANCE_LABEL, GRADE_NUMBER, HOMEWORK_LABEL
from cohortpulse.sources.schemas import KEY
from cohortpulse.sources.tables import Tables


def clean_students(raw: DataFrame, as_of: date) -> DataFrame:
    return raw.select(
        strip(F.col(KEY)).alias(KEY),
        "Full_Name",
        "Grade_Level",
        lookup(F.col("Grade_Level"), GRADE_NUMBER).alias("Grade_Num"),
        age_by_days(parse_mixed_date(F.col("Date_of_Birth")), as_of).alias("Age"),
    )


def clean_attendance(raw: DataFrame) -> DataFrame:
    day = F.col("Date").cast("date")
    return raw.select(
        strip(F.col(KEY)).alias(KEY),
        day.alias("Date"),
        "Subject",
        lookup(F.upper(strip(F.col("Attendance_Status"))), ATTENDANCE_LABEL).alias("Attendance_Status"),
        month_label(day).alias("Month"),
    )


def clean_homework(raw: DataFrame, *more: Column) -> DataFrame:
    """A blank, missing or unknown signature is no evidence of a sign-off: False. ``more`` are further columns of raw."""
    return raw.select(
        strip(F.col(KEY)).alias(KEY),
        "Subject",
        parse_mixed_date(F.col("Due_Date")).alias("Due_Date"),
        lookup(strip(F.col("Status")), HOMEWORK_LABEL).alias("Status"),
        F.coalesce(strip(F.col("Guardian_Signature")) == "Yes", F.lit(False)).alias("Guardian_Signature"),
        "Grade_Feedback",
        *more,
    )


def parse_performance(raw: DataFrame, negative: str = "tenth") -> DataFrame:
    """Clean performance before gaps in the completion rate are filled."""
    percent = F.col("Homework_Completion_%")
    return raw.select(
        strip(F.col(KEY)).alias(KEY),
        "Subject",
        whole_number(F.col("Exam_Score")).alias("Exam_Score"),
        percent,
        percent_fraction(percent, negative).alias("CompletionRate"),
    )


def clean_performance(raw: DataFrame, negative: str = "tenth") -> DataFrame:
    """Gaps in the completion rate get the median of their subject."""
    return fill_with_group_median(parse_performance(raw, negative), "Subject", "CompletionRate")


def clean_communication(raw: DataFrame) -> DataFrame:
    day = F.col("Date").cast("date")
    return raw.select(
        strip(F.col(KEY)).alias(KEY), day.alias("Date"), "Message_Type", month_label(day).alias("Month")
    )


def clean_tables(raw: Tables, as_of: date, negative: str = "tenth") -> Tables:
    """The five clean tables and, for features that do not use the filled rate, ``parsed_performance``."""
    build = {
        "students": lambda: clean_students(raw["students"], as_of),
        "attendance": lambda: clean_attendance(raw["attendance"]),
        "homework": lambda: clean_homework(raw["homework"]),
        "performance": lambda: clean_performance(raw["performance"], negative),
        "parsed_performance": lambda: parse_performance(raw["performance"], negative),
        "communication": lambda: clean_communication(raw["teacher_parent_communication"]),
    }
    return Tables(lambda name: build[name]())
