"""The five raw school tables, derived from the driver's Parquet tables (rules: FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.sources.schemas import KEY
from cohortpulse.sources.tables import Tables

# The domains of the raw columns.
SUBJECTS = ("Math", "Arabic", "Science", "History", "English", "Geography")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ATTENDANCE = ("PRESENT", "Present", " late", "Late", "Absent", "absnt", "Left Early", "Excused")
HOMEWORK = ("✔", "✅", " Done ", "❌", "not done", "pending")
SIGNATURE = ("Yes", "No", " ")
LETTERS = ("A+", "A", "B", "B-", "C", "C-", "D", "F")


def _pick(values: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _digits(n: Column, width: int) -> Column:
    """Zero-padded to at least ``width`` digits."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def _key(n: Column) -> Column:
    return F.concat(F.lit("S"), _digits(n, 6))


def _cents() -> Column:
    return F.round(F.col("o_totalprice") * 100).cast("bigint")


def _day(c: Column, us_format: Column) -> Column:
    return F.when(us_format, F.date_format(c, "MM-dd-yyyy")).otherwise(c.cast("date").cast("string"))


def _students(files: Tables) -> DataFrame:
    n = F.col("c_custkey")
    born = F.date_add(F.lit("2005-01-01").cast("date"), (n * 37 % 4745).cast("int"))
    padded = F.concat(
        F.when(n % 7 == 0, " ").otherwise(""), _key(n), F.when(n % 11 == 0, " ").otherwise("")
    )
    grade = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
    return files["customer"].select(
        padded.alias(KEY),
        F.col("c_name").alias("Full_Name"),
        F.concat(F.lit("Grade "), grade.cast("string")).alias("Grade_Level"),
        _day(born, n % 10 == 0).alias("Date_of_Birth"),
        F.concat(F.lit("555-"), F.lpad((n % 10000).cast("string"), 4, "0")).alias("Emergency_Contact"),
    )


def _attendance(files: Tables) -> DataFrame:
    """Texts are made after the join, so that only numbers are shuffled for it."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    status = _pick(ATTENDANCE, (F.col("l_orderkey") * 7 + part + line * 3) % 8)
    orders = files["orders"].select("o_orderkey", "o_custkey")
    return (
        files["lineitem"]
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _key(F.col("o_custkey")).alias(KEY),
            F.col("l_shipdate").cast("date").cast("string").alias("Date"),
            _pick(SUBJECTS, part % 6).alias("Subject"),
            F.when((part + line) % 499 == 0, "unknwn").otherwise(status).alias("Attendance_Status"),
        )
    )


def _homework(files: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    return files["orders"].select(
        _key(F.col("o_custkey")).alias(KEY),
        F.concat(F.lit("HW-"), (n % 20).cast("string")).alias("Assignment_Name"),
        _pick(SUBJECTS, n % 6).alias("Subject"),
        _day(F.col("o_orderdate"), n % 9 == 0).alias("Due_Date"),
        F.when(n % 251 == 0, "n/a").otherwise(_pick(HOMEWORK, _cents() % 6)).alias("Status"),
        F.when(n % 97 != 0, _pick(SIGNATURE, n % 3)).alias("Guardian_Signature"),
        _pick(LETTERS, n % 8).alias("Grade_Feedback"),
    )


def _performance(files: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    whole = (n % 51 + 50).cast("string")
    percent = (
        F.when(n % 5 == 0, "-5")
        .when(n % 5 == 1, whole)
        .when(n % 5 == 2, F.concat(whole, F.lit("%")))
        .when(n % 5 == 3, F.concat(F.lit("0."), (n % 90 + 10).cast("string")))
    )
    subject = _pick(SUBJECTS, F.call_function("div", n, F.lit(3)) % 6)
    return files["orders"].select(
        _key(F.col("o_custkey")).alias(KEY),
        F.when(n % 303 != 0, subject).alias("Subject"),
        # one student in thirteen is weak, so that questions about failing students have answers
        F.when(F.col("o_custkey") % 13 == 0, _cents() % 13 + 40).otherwise(_cents() % 71 + 40).cast("int").alias("Exam_Score"),
        percent.alias("Homework_Completion_%"),
        F.concat(F.lit("note "), n.cast("string")).alias("Teacher_Comments"),
    )


def _communication(files: Tables) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    orphan = (kind == "signup") & (n % 50 == 0)
    day = F.date_add(F.col("ts").cast("date"), (n % 180).cast("int"))
    return files["events"].select(
        F.when(orphan, F.concat(F.lit("S9"), _digits(F.col("user_id"), 5))).otherwise(_key(F.col("user_id"))).alias(KEY),
        day.cast("string").alias("Date"),
        F.when(kind == "click", "Teacher to Parent")
        .when(kind == "view", "Parent to Teacher")
        .otherwise("Automated Reminder")
        .alias("Message_Type"),
        F.concat(F.lit("msg "), n.cast("string")).alias("Message_Content"),
    )


_BUILDERS = {
    "students": _students,
    "attendance": _attendance,
    "homework": _homework,
    "performance": _performance,
    "teacher_parent_communication": _communication,
}


@lru_cache(maxsize=8)
def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The raw tables of a folder, defined once per session: its files are listed and their schemas read once."""
    files = Tables(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return Tables(lambda name: _BUILDERS[name](files))
