"""The story queries over raw tables: text is normalised inside each query, keys come stripped.

Results are ordered as a reader expects them, with a last tie-break that makes the order unique.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortpulse.functions import (
    RECORD_BANDS,
    age_by_year,
    band,
    bit_text,
    exact_avg,
    exact_pct,
    month_label,
    month_start,
    same_text,
    sql_upper_trim,
    strip,
    whole_number,
)
from cohortpulse.operators.aggregate import (
    collapse_copies,
    count_where,
    flag,
    one,
    share_of_total,
    sums_by_attribute,
)
from cohortpulse.operators.fanout import as_bigint, join_profile, multiplicity, product
from cohortpulse.operators.rank import top_n
from cohortpulse.plans.labels import (
    AUTOMATED,
    FAILING,
    SQL_ABSENT,
    SQL_DONE,
    SQL_NOT_DONE,
    TO_PARENT,
    TO_TEACHER,
    RiskRule,
)
from cohortpulse.sources.schemas import KEY
from cohortpulse.sources.tables import Tables

COMMUNICATION = "teacher_parent_communication"
STUDENT = (KEY, "Full_Name", "Grade_Level")


def with_stripped_keys(raw: Tables) -> Tables:
    return raw.map(lambda _, df: df.withColumn(KEY, strip(F.col(KEY))))


def _attendance() -> Column:
    return sql_upper_trim(F.col("Attendance_Status"))


def _homework() -> Column:
    return sql_upper_trim(F.col("Status"))


def _score() -> Column:
    return whole_number(F.col("Exam_Score"))


def _score_measures() -> dict[str, Column]:
    return {"score_sum": _score().cast("bigint"), "scores": flag(_score().isNotNull())}


# Who are the students?


def grade_distribution(raw: Tables) -> DataFrame:
    return share_of_total(raw["students"], "Grade_Level", "Total_Students", "Pct_of_School").orderBy("Grade_Level")


def age_spread_iso(raw: Tables, as_of: date) -> DataFrame:
    """Ages by calendar year over birth dates written year first; the mean is cut to a whole number."""
    age = age_by_year(F.col("Date_of_Birth").try_cast("date"), as_of)
    return (
        raw["students"]
        .filter(F.col("Date_of_Birth").like("____-__-__%"))
        .select("Grade_Level", age.alias("age"))
        .groupBy("Grade_Level")
        .agg(
            F.min("age").alias("Min_Age"),
            F.max("age").alias("Max_Age"),
            F.expr("cast(sum(age) div nullif(count(age), 0) as int)").alias("Avg_Age"),
        )
        .orderBy("Grade_Level")
    )


# Are they showing up?


def attendance_status_landscape(raw: Tables) -> DataFrame:
    return share_of_total(raw["attendance"], _attendance().alias("Status")).orderBy(F.desc("Count"), "Status")


def attendance_rate_by_grade(raw: Tables) -> DataFrame:
    sums = sums_by_attribute(
        raw["attendance"],
        raw["students"],
        KEY,
        ["Grade_Level"],
        {"Total_Records": one(), "Present_Count": flag(_attendance() == "PRESENT")},
    )
    rate = exact_pct(F.col("Present_Count"), F.col("Total_Records"))
    return sums.withColumn("Present_Rate_Pct", rate).orderBy("Present_Rate_Pct", "Grade_Level")


def attendance_by_subject(raw: Tables) -> DataFrame:
    status = F.col("status")
    counted = count_where(
        raw["attendance"].select("Subject", _attendance().alias("status")),
        ["Subject"],
        "total",
        present=status == "PRESENT",
        Absent_Count=status.isin(*SQL_ABSENT),
        Late_Count=status == "LATE",
        Left_Early_Count=status == "LEFT EARLY",
    )
    return counted.select(
        "Subject",
        exact_pct(F.col("present"), F.col("total")).alias("Present_Rate_Pct"),
        "Absent_Count",
        "Late_Count",
        "Left_Early_Count",
    ).orderBy("Present_Rate_Pct", "Subject")


def late_rate_by_subject(raw: Tables) -> DataFrame:
    counted = count_where(raw["attendance"], ["Subject"], "Total", Late_Count=_attendance() == "LATE")
    return counted.select(
        "Subject", "Late_Count", "Total", exact_pct(F.col("Late_Count"), F.col("Total")).alias("Late_Rate_Pct")
    ).orderBy(F.desc("Late_Rate_Pct"), "Subject")


def monthly_attendance_trend(raw: Tables) -> DataFrame:
    month = month_start(F.col("Date").cast("date")).alias("month")
    counted = count_where(raw["attendance"], [month], "total", present=_attendance() == "PRESENT")
    return counted.select(
        month_label(F.col("month")).alias("Month"),
        exact_pct(F.col("present"), F.col("total")).alias("Present_Rate_Pct"),
    ).orderBy("Month")


# Are they doing their work?


def homework_status_landscape(raw: Tables) -> DataFrame:
    return share_of_total(raw["homework"], F.trim("Status").alias("Raw_Status")).orderBy(
        F.desc("Count"), "Raw_Status"
    )


def homework_completion_by_subject(raw: Tables) -> DataFrame:
    status = F.col("status")
    counted = count_where(
        raw["homework"].select("Subject", _homework().alias("status")),
        ["Subject"],
        "total",
        Completed=status.isin(*SQL_DONE),
        Not_Completed=status.isin(*SQL_NOT_DONE),
        Pending=status == "PENDING",
    )
    return counted.select(
        "Subject",
        "Completed",
        "Not_Completed",
        "Pending",
        exact_pct(F.col("Completed"), F.col("total")).alias("Completion_Rate_Pct"),
    ).orderBy("Completion_Rate_Pct", "Subject")


def completion_by_signature(raw: Tables) -> DataFrame:
    """A missing signature is a group of its own."""
    signed = bit_text(F.col("Guardian_Signature")).alias("Signed")
    counted = count_where(raw["homework"], [signed], "Total", Completed=_homework().isin(*SQL_DONE))
    return counted.withColumn(
        "Completion_Rate_Pct", exact_pct(F.col("Completed"), F.col("Total"))
    ).orderBy(F.desc("Completion_Rate_Pct"), "Signed")


def feedback_distribution(raw: Tables) -> DataFrame:
    return share_of_total(raw["homework"], "Grade_Feedback").orderBy(F.desc("Count"), "Grade_Feedback")


def pending_rate_by_grade(raw: Tables) -> DataFrame:
    sums = sums_by_attribute(
        raw["homework"],
        raw["students"],
        KEY,
        ["Grade_Level"],
        {"Pending_Count": flag(_homework() == "PENDING"), "Total": one()},
    )
    rate = exact_pct(F.col("Pending_Count"), F.col("Total"))
    return sums.withColumn("Pending_Rate_Pct", rate).orderBy(F.desc("Pending_Rate_Pct"), "Grade_Level")


# Are they performing?


def score_band_distribution(raw: Tables) -> DataFrame:
    """Ordered by the lowest score of each band. There are five bands at most, so the total may come from a
    window over them."""
    groups = (
        raw["performance"]
        .select(_score().alias("score"))
        .groupBy(band(F.col("score"), RECORD_BANDS).alias("Score_Band"))
        .agg(F.count("*").alias("Count"), F.min("score").alias("lowest"))
    )
    total = F.sum("Count").over(Window.partitionBy())
    return groups.withColumn("Pct", exact_pct(F.col("Count"), total)).orderBy("lowest").drop("lowest")


def score_by_subject(raw: Tables) -> DataFrame:
    score = F.col("score")
    return (
        raw["performance"]
        .select("Subject", _score().alias("score"))
        .groupBy("Subject")
        .agg(
            exact_avg(F.sum(score), F.count(score)).alias("Avg_Score"),
            F.min(score).alias("Min_Score"),
            F.max(score).alias("Max_Score"),
            F.count("*").alias("Records"),
        )
        .orderBy("Avg_Score", "Subject")
    )


def score_by_grade(raw: Tables) -> DataFrame:
    sums = sums_by_attribute(
        raw["performance"], raw["students"], KEY, ["Grade_Level"], {**_score_measures(), "Records": one()}
    )
    return sums.select(
        "Grade_Level", exact_avg(F.col("score_sum"), F.col("scores")).alias("Avg_Score"), "Records"
    ).orderBy("Grade_Level")


def _student_averages(raw: Tables) -> DataFrame:
    """Mean exam score per student with an exam; equal student rows count once."""
    sums = raw["performance"].groupBy(KEY).agg(*(F.sum(m).alias(n) for n, m in _score_measures().items()))
    students = collapse_copies(raw["students"], *STUDENT).drop("copies")
    average = exact_avg(F.col("score_sum"), F.col("scores")).alias("Avg_Score")
    return students.join(sums, KEY).select(*STUDENT, average)


def top10_students(raw: Tables) -> DataFrame:
    return top_n(_student_averages(raw), 10, F.desc("Avg_Score"), KEY)


def bottom10_students(raw: Tables) -> DataFrame:
    return top_n(_student_averages(raw), 10, F.asc("Avg_Score"), KEY)


# Are parents in the loop?


def message_type_split(raw: Tables) -> DataFrame:
    return share_of_total(raw[COMMUNICATION], "Message_Type").orderBy(F.desc("Count"), "Message_Type")


def monthly_message_volume(raw: Tables) -> DataFrame:
    kind = F.col("Message_Type")
    counted = count_where(
        raw[COMMUNICATION],
        [month_start(F.col("Date").cast("date")).alias("month")],
        "Total_Messages",
        Parent_Initiated=same_text(kind, TO_TEACHER),
        Teacher_Initiated=same_text(kind, TO_PARENT),
        Automated=same_text(kind, AUTOMATED),
    )
    return counted.select(
        month_label(F.col("month")).alias("Month"),
        "Total_Messages",
        "Parent_Initiated",
        "Teacher_Initiated",
        "Automated",
    ).orderBy("Month")


def _contact_profile(raw: Tables, *columns: str) -> DataFrame:
    return join_profile(
        collapse_copies(raw["students"], *columns),
        KEY,
        {"performance": (raw["performance"], _score_measures()), "messages": (raw[COMMUNICATION], {})},
    )


def contact_vs_score(raw: Tables) -> DataFrame:
    """Mean exam score of students with and without messages, each exam counted once per message, as the join
    of exams and messages would."""
    return contact_scores(_contact_profile(raw, KEY))


def contact_scores(per_student: DataFrame) -> DataFrame:
    """:func:`contact_vs_score` from the sums of each student."""
    weight = product(F.col("copies"), multiplicity(F.col("n_messages"))).cast("decimal(19,0)")
    return (
        per_student.select(
            F.when(F.col("n_messages").isNull(), "No Communication")
            .otherwise("Has Communication")
            .alias("Communication_Status"),
            KEY,
            (weight * F.col("score_sum").cast("decimal(19,0)")).alias("weighted_sum"),
            (weight * F.col("scores").cast("decimal(19,0)")).alias("weighted_scores"),
        )
        .groupBy("Communication_Status")
        .agg(
            F.count(KEY).alias("Student_Count"),
            exact_avg(F.sum("weighted_sum"), F.sum("weighted_scores")).alias("Avg_Exam_Score"),
        )
    )


def contact_coverage_by_grade(raw: Tables) -> DataFrame:
    """Ids are made distinct on both sides before they are joined and counted: no row expansion, no hot key."""
    contacted = raw[COMMUNICATION].select(KEY).distinct().withColumn("contacted", F.lit(True))
    counted = (
        raw["students"]
        .select(KEY, "Grade_Level")
        .distinct()
        .join(contacted, KEY, "left")
        .groupBy("Grade_Level")
        .agg(
            F.count(KEY).alias("Total_Students"),
            F.count("contacted").alias("Students_With_Comms"),
        )
    )
    silent = F.col("Total_Students") - F.col("Students_With_Comms")
    return (
        counted.withColumn("Silent_Students", silent)
        .withColumn("Silent_Pct", exact_pct(F.col("Silent_Students"), F.col("Total_Students")))
        .orderBy(F.desc("Silent_Pct"), "Grade_Level")
    )


def top5_contacted(raw: Tables) -> DataFrame:
    """``Message_Count`` counts the rows of messages joined with exams, so it exceeds the messages."""
    return _countable(most_contacted(_contact_profile(raw, *STUDENT)), "Message_Count")


def most_contacted(per_student: DataFrame, n: int = 5) -> DataFrame:
    """Ranks the sums of each student; ``Message_Count`` stays a decimal."""
    rows = product(F.col("copies"), F.col("n_messages"), multiplicity(F.col("n_performance")))
    counted = (
        per_student.filter("n_messages > 0")
        .select(
            *STUDENT,
            rows.alias("Message_Count"),
            exact_avg(F.col("score_sum"), F.col("scores")).alias("Avg_Exam_Score"),
        )
    )
    return top_n(counted, n, F.desc("Message_Count"), KEY)


def contacted_but_failing(raw: Tables) -> DataFrame:
    """``Communication_Count`` is the number of different days with a message."""
    days = raw[COMMUNICATION].groupBy(KEY).agg(F.count_distinct("Date").alias("Communication_Count"))
    return (
        _student_averages(raw)
        .withColumnRenamed("Avg_Score", "Avg_Exam_Score")
        .filter(F.col("Avg_Exam_Score") < FAILING)
        .join(days, KEY)
        .orderBy(F.desc("Communication_Count"), "Avg_Exam_Score", KEY)
    )


# Who needs intervention now?


def at_risk_fanout(raw: Tables, rule: RiskRule = RiskRule()) -> DataFrame:
    """Students at risk as the join of all four facts reports them: ``Missed_Assignments`` is multiplied by the
    rows of the other facts. Computed from one row per student; the join itself is never built. Counts are compared
    as exact decimals; one beyond 64 bits ends the query with a message."""
    return _countable(at_risk_of(_risk_profile(raw), rule), "Missed_Assignments")


def _countable(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, as_bigint(F.col(column)))


def _risk_profile(raw: Tables) -> DataFrame:
    return join_profile(
        collapse_copies(raw["students"], *STUDENT),
        KEY,
        {
            "attendance": (raw["attendance"], {"present": flag(_attendance() == "PRESENT")}),
            "performance": (raw["performance"], _score_measures()),
            "homework": (raw["homework"], {"missed": flag(_homework().isin(*SQL_NOT_DONE))}),
            "messages": (raw[COMMUNICATION], {}),
        },
    )


def at_risk_of(per_student: DataFrame, rule: RiskRule = RiskRule()) -> DataFrame:
    """The rule over the sums of each student; ``Missed_Assignments`` stays a decimal."""
    missed = F.coalesce("missed", F.lit(0).cast("bigint"))
    inflated = product(
        missed,
        F.col("copies"),
        *(multiplicity(F.col(f"n_{fact}")) for fact in ("attendance", "performance", "messages")),
    )
    return (
        per_student.select(
            *STUDENT,
            exact_pct(F.col("present"), F.col("n_attendance")).alias("Attendance_Rate_Pct"),
            exact_avg(F.col("score_sum"), F.col("scores")).alias("Avg_Exam_Score"),
            inflated.alias("Missed_Assignments"),
            F.when(F.col("n_messages").isNull(), "No").otherwise("Yes").alias("Has_Parent_Contact"),
        )
        .filter(
            (F.col("Attendance_Rate_Pct") < rule.attendance)
            & (F.col("Avg_Exam_Score") < rule.score)
            & (F.col("Missed_Assignments") > rule.missed)
        )
        .orderBy("Avg_Exam_Score", "Attendance_Rate_Pct", KEY)
    )
