"""Dashboard measures over the clean tables and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions import exact_avg, exact_pct, month_label, month_start
from cohortpulse.operators.aggregate import collapse_copies, count_where, share_of_total
from cohortpulse.plans.features import ATTENDANCE_RATE, student_profile, student_summary, with_features
from cohortpulse.plans.labels import FAILING, HIGH_ACHIEVER, SCORE_BIN, SCORE_FLOOR
from cohortpulse.sources.schemas import KEY
from cohortpulse.sources.tables import Tables


def _rate(part: str, whole: str):
    return exact_pct(F.col(part), F.col(whole))


def _hundredths(rate):
    """A number rounded to two digits as a whole number of hundredths, so that sums of it are exact."""
    return F.rint(rate * 100).cast("bigint")


def _mean_of_rounded(column: str):
    """Mean of a column of two-digit numbers, half up to two digits."""
    hundredths = _hundredths(F.col(column))
    return exact_avg(F.sum(hundredths), F.count(hundredths) * 100)


def _copies_per_student(clean: Tables) -> DataFrame:
    return collapse_copies(clean["students"], KEY)


# Executive summary


def kpi_executive(clean: Tables) -> DataFrame:
    """Rates and the mean are over all records, those of unknown students included; enrolment and the at-risk
    count are over student rows. One outer join of per-student sums serves both, so each table is read once."""
    # no measure asks for messages, so they are not read
    joined = _copies_per_student(clean).join(student_profile(clean, without=("communication",)), KEY, "full")
    totals = with_features(joined.withColumn("n_communication", F.lit(None).cast("bigint"))).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("Total_Enrollment"),
        F.coalesce(F.sum(F.when(F.col("Is_At_Risk"), F.col("copies"))), F.lit(0)).alias("At_Risk_Count"),
        *(
            F.sum(c).alias(c)
            for c in ("score_sum", "scores", "present", "n_attendance", "done", "n_homework")
        ),
    )
    return totals.select(
        "Total_Enrollment",
        exact_avg(F.col("score_sum"), F.col("scores")).alias("Avg_Score"),
        "At_Risk_Count",
        _rate("present", "n_attendance").alias("Attendance_Rate_Pct"),
        _rate("done", "n_homework").alias("HW_Completion_Rate_Pct"),
    )


def student_score_bands(clean: Tables) -> DataFrame:
    counted = student_summary(clean).groupBy("Score_Band").agg(F.count("*").alias("Students"))
    return counted.orderBy(F.desc("Students"), "Score_Band")


def at_risk_by_grade(clean: Tables) -> DataFrame:
    counted = student_summary(clean).groupBy("Grade_Level").agg(F.count_if("Is_At_Risk").alias("At_Risk"))
    return counted.orderBy("Grade_Level")


def monthly_attendance(clean: Tables) -> DataFrame:
    month = month_start(F.col("Date")).alias("month")
    counted = count_where(clean["attendance"], [month], "Records", present=F.col("Attendance_Status") == "Present")
    return counted.select(
        month_label(F.col("month")).alias("Month"), "Records", _rate("present", "Records").alias("Present_Rate_Pct")
    ).orderBy("Month")


# Attendance


def _status(label: str):
    return F.col("Attendance_Status") == label


def kpi_attendance(clean: Tables) -> DataFrame:
    counted = count_where(
        clean["attendance"],
        [],
        "Records",
        present=_status("Present"),
        absent=_status("Absent"),
        late=_status("Late"),
        left=_status("Left Early"),
    )
    return counted.select(
        "Records",
        _rate("present", "Records").alias("Attendance_Rate_Pct"),
        _rate("absent", "Records").alias("Absence_Rate_Pct"),
        _rate("late", "Records").alias("Late_Rate_Pct"),
        _rate("left", "Records").alias("Left_Early_Rate_Pct"),
    )


def absence_tardiness_by_subject(clean: Tables) -> DataFrame:
    counted = count_where(
        clean["attendance"], ["Subject"], "Records", Absent_Count=_status("Absent"), Late_Count=_status("Late")
    )
    return counted.orderBy("Subject")


def status_by_subject(clean: Tables) -> DataFrame:
    counted = clean["attendance"].groupBy("Subject", "Attendance_Status").agg(F.count("*").alias("Records"))
    return counted.orderBy("Subject", "Attendance_Status")


def avg_attendance_rate_by_grade(clean: Tables) -> DataFrame:
    """Mean of the students' own rates; each student counts once, however many records there are."""
    means = student_summary(clean).groupBy("Grade_Level").agg(
        _mean_of_rounded("Attendance_Rate_%").alias("Avg_Attendance_Rate")
    )
    return means.orderBy("Grade_Level")


# Homework


def kpi_homework(clean: Tables) -> DataFrame:
    status = F.col("Status")
    counted = count_where(
        clean["homework"],
        [],
        "Assignments",
        pending=status == "Pending",
        missed=status == "Not Done",
        done=status == "Done",
    )
    return counted.select(
        "Assignments",
        _rate("pending", "Assignments").alias("Pending_Rate_Pct"),
        _rate("missed", "Assignments").alias("Missed_Rate_Pct"),
        _rate("done", "Assignments").alias("Completion_Rate_Pct"),
    )


def completion_donut(clean: Tables) -> DataFrame:
    """Shares of the mapped labels."""
    labelled = clean["homework"].filter(F.col("Status").isNotNull())
    return share_of_total(labelled, "Status").orderBy(F.desc("Count"), "Status")


def completion_rate_by_subject_clean(clean: Tables) -> DataFrame:
    counted = count_where(clean["homework"], ["Subject"], "Assignments", Done=F.col("Status") == "Done")
    return counted.withColumn("Completion_Rate_Pct", _rate("Done", "Assignments")).orderBy(
        "Completion_Rate_Pct", "Subject"
    )


# Performance


def kpi_scores(clean: Tables) -> DataFrame:
    score = F.col("Exam_Score")
    return (
        clean["parsed_performance"]
        .agg(
            F.min(score).alias("Min_Score"),
            F.max(score).alias("Max_Score"),
            F.count(score).alias("scores"),
            F.count_if(score < FAILING).alias("failing"),
            F.count_if(score >= HIGH_ACHIEVER).alias("High_Achievers"),
        )
        .select("Min_Score", "Max_Score", _rate("failing", "scores").alias("Failing_Rate_Pct"), "High_Achievers")
    )


def score_by_subject_grade(clean: Tables) -> DataFrame:
    """Exams are first summed per student and subject, then joined to the grade."""
    score = F.col("Exam_Score")
    per_student = (
        clean["parsed_performance"]
        .groupBy(KEY, "Subject")
        .agg(F.sum(score).alias("total"), F.count(score).alias("scores"))
    )
    return (
        per_student.join(collapse_copies(clean["students"], KEY, "Grade_Level"), KEY)
        .groupBy("Subject", "Grade_Level")
        .agg(
            exact_avg(F.sum(F.expr("total * copies")), F.sum(F.expr("scores * copies"))).alias("Avg_Score")
        )
        .orderBy("Subject", "Grade_Level")
    )


def score_histogram(clean: Tables) -> DataFrame:
    score = F.col("Exam_Score")
    start = (F.floor((score - SCORE_FLOOR) / SCORE_BIN) * SCORE_BIN + SCORE_FLOOR).cast("int")
    return (
        clean["parsed_performance"]
        .filter(score.isNotNull())
        .groupBy(start.alias("Bin_Start"))
        .agg(F.count("*").alias("Records"))
        .orderBy("Bin_Start")
    )


# Parent communication


def kpi_contact(clean: Tables) -> DataFrame:
    """Messages, those to unknown students included, and student rows without any."""
    messages = clean["communication"].groupBy(KEY).agg(F.count("*").alias("messages"))
    joined = _copies_per_student(clean).join(messages, KEY, "full")
    return joined.agg(
        F.coalesce(F.sum("messages"), F.lit(0)).alias("Total_Messages"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("Total_Students"),
        F.coalesce(F.sum(F.when(F.col("messages").isNull(), F.col("copies"))), F.lit(0)).alias("Silent_Students"),
    )


def silent_by_grade(clean: Tables) -> DataFrame:
    """A student is silent without messages: an anti join on distinct ids, nothing is counted per message."""
    heard = clean["communication"].select(KEY).distinct()
    silent = collapse_copies(clean["students"], KEY, "Grade_Level").join(heard, KEY, "left_anti")
    return silent.groupBy("Grade_Level").agg(F.sum("copies").alias("Silent_Students")).orderBy("Grade_Level")


def message_volume_trend(clean: Tables) -> DataFrame:
    month = month_start(F.col("Date")).alias("month")
    return (
        clean["communication"]
        .groupBy(month, "Message_Type")
        .agg(F.count("*").alias("Messages"))
        .select(month_label(F.col("month")).alias("Month"), "Message_Type", "Messages")
        .orderBy("Month", "Message_Type")
    )


# At-risk intervention


def at_risk_cohort_kpi(clean: Tables) -> DataFrame:
    summary = student_summary(clean)
    flagged = [
        F.when(F.col("Is_At_Risk"), _hundredths(F.col(c))) for c in ("Avg_Exam_Score", "Attendance_Rate_%")
    ]
    score, attendance = (exact_avg(F.sum(c), F.count(c) * 100) for c in flagged)
    return summary.agg(
        F.count_if("Is_At_Risk").alias("At_Risk_Students"),
        score.alias("Avg_Score"),
        attendance.alias("Avg_Attendance_Rate"),
        exact_pct(F.count_if("Is_At_Risk"), F.count("*")).alias("At_Risk_Pct"),
    )


def risk_scatter(clean: Tables) -> DataFrame:
    return student_summary(clean).select(KEY, ATTENDANCE_RATE, "Avg_Exam_Score", "Is_At_Risk")


def at_risk_table(clean: Tables) -> DataFrame:
    return (
        student_summary(clean)
        .filter("Is_At_Risk")
        .select(
            KEY,
            "Full_Name",
            "Grade_Level",
            ATTENDANCE_RATE,
            "HW_Completion_%",
            "Avg_Exam_Score",
            "Missed_Assignments",
            "Comm_Count",
            "Has_Communication",
            "Score_Band",
        )
        .orderBy("Avg_Exam_Score", ATTENDANCE_RATE, KEY)
    )
