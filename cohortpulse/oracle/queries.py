"""DuckDB SQL per query name."""

from __future__ import annotations

from collections.abc import Collection

from cohortpulse.oracle.views import AS_OF, avg2, even, pct, with_views

DONE = "upper(trim(Status)) IN ('DONE', '✔', '✅')"
MISSED = "upper(trim(Status)) IN ('NOT DONE', '❌')"
PRESENT = "upper(trim(Attendance_Status)) = 'PRESENT'"


def n(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def _share(table: str, key: str, name: str, count: str = "Count", share: str = "Pct") -> str:
    return f"""
        SELECT {key} AS {name}, count(*) AS "{count}",
               {pct("count(*)", "sum(count(*)) OVER ()")} AS "{share}"
        FROM {table} GROUP BY {key}"""


def _ranked(direction: str) -> str:
    return f"""
        SELECT p.Student_ID, s.Full_Name, s.Grade_Level,
               {avg2("sum(p.Exam_Score)", "count(p.Exam_Score)")} AS Avg_Score
        FROM key_performance p JOIN key_students s ON p.Student_ID = s.Student_ID
        GROUP BY p.Student_ID, s.Full_Name, s.Grade_Level
        ORDER BY Avg_Score {direction}, p.Student_ID LIMIT 10"""


# The labels of the bands, as the reports print them.
RECORD_BAND = """CASE WHEN Exam_Score < 60 THEN 'Failing   (<60)' WHEN Exam_Score < 75 THEN 'Average   (60-74)'
    WHEN Exam_Score < 90 THEN 'Good      (75-89)' WHEN Exam_Score <= 100 THEN 'Excellent (90-100)'
    ELSE 'High      (101-110)' END"""

STORY = {
    "grade_distribution": _share("key_students", "Grade_Level", "Grade_Level", "Total_Students", "Pct_of_School"),
    "age_spread_iso": f"""
        SELECT Grade_Level, min(age)::INT AS Min_Age, max(age)::INT AS Max_Age, (sum(age) // count(age))::INT AS Avg_Age
        FROM (SELECT Grade_Level, year({AS_OF}) - year(try_cast(Date_of_Birth AS DATE)) AS age
              FROM key_students WHERE Date_of_Birth LIKE '____-__-__%')
        GROUP BY Grade_Level""",
    "attendance_status_landscape": _share("key_attendance", "upper(trim(Attendance_Status))", "Status"),
    "attendance_rate_by_grade": f"""
        SELECT s.Grade_Level, count(*) AS Total_Records, {n(PRESENT)} AS Present_Count,
               {pct(n(PRESENT), "count(*)")} AS Present_Rate_Pct
        FROM key_attendance a JOIN key_students s ON a.Student_ID = s.Student_ID GROUP BY s.Grade_Level""",
    "attendance_by_subject": f"""
        SELECT Subject, {pct(n(PRESENT), "count(*)")} AS Present_Rate_Pct,
               {n("upper(trim(Attendance_Status)) IN ('ABSENT', 'ABSNT')")} AS Absent_Count,
               {n("upper(trim(Attendance_Status)) = 'LATE'")} AS Late_Count,
               {n("upper(trim(Attendance_Status)) = 'LEFT EARLY'")} AS Left_Early_Count
        FROM key_attendance GROUP BY Subject""",
    "late_rate_by_subject": f"""
        SELECT Subject, {n("upper(trim(Attendance_Status)) = 'LATE'")} AS Late_Count, count(*) AS Total,
               {pct(n("upper(trim(Attendance_Status)) = 'LATE'"), "count(*)")} AS Late_Rate_Pct
        FROM key_attendance GROUP BY Subject""",
    "monthly_attendance_trend": f"""
        SELECT strftime(Date::DATE, '%Y-%m') AS Month, {pct(n(PRESENT), "count(*)")} AS Present_Rate_Pct
        FROM key_attendance GROUP BY 1""",
    "homework_status_landscape": _share("key_homework", "trim(Status)", "Raw_Status"),
    "homework_completion_by_subject": f"""
        SELECT Subject, {n(DONE)} AS Completed, {n(MISSED)} AS Not_Completed,
               {n("upper(trim(Status)) = 'PENDING'")} AS Pending,
               {pct(n(DONE), "count(*)")} AS Completion_Rate_Pct
        FROM key_homework GROUP BY Subject""",
    "completion_by_signature": f"""
        SELECT CASE trim(Guardian_Signature) WHEN 'Yes' THEN '1' WHEN 'No' THEN '0' END AS Signed,
               count(*) AS Total, {n(DONE)} AS Completed, {pct(n(DONE), "count(*)")} AS Completion_Rate_Pct
        FROM key_homework GROUP BY 1""",
    "feedback_distribution": _share("key_homework", "Grade_Feedback", "Grade_Feedback"),
    "pending_rate_by_grade": f"""
        SELECT s.Grade_Level, {n("upper(trim(h.Status)) = 'PENDING'")} AS Pending_Count, count(*) AS Total,
               {pct(n("upper(trim(h.Status)) = 'PENDING'"), "count(*)")} AS Pending_Rate_Pct
        FROM key_homework h JOIN key_students s ON h.Student_ID = s.Student_ID GROUP BY s.Grade_Level""",
    "score_band_distribution": _share("key_performance", RECORD_BAND, "Score_Band"),
    "score_by_subject": f"""
        SELECT Subject, {avg2("sum(Exam_Score)", "count(Exam_Score)")} AS Avg_Score,
               min(Exam_Score) AS Min_Score, max(Exam_Score) AS Max_Score, count(*) AS Records
        FROM key_performance GROUP BY Subject""",
    "score_by_grade": f"""
        SELECT s.Grade_Level, {avg2("sum(p.Exam_Score)", "count(p.Exam_Score)")} AS Avg_Score, count(*) AS Records
        FROM key_performance p JOIN key_students s ON p.Student_ID = s.Student_ID GROUP BY s.Grade_Level""",
    "top10_students": _ranked("DESC NULLS LAST"),
    "bottom10_students": _ranked("ASC NULLS FIRST"),
    "message_type_split": _share("key_communication", "Message_Type", "Message_Type"),
    "monthly_message_volume": f"""
        SELECT strftime(Date::DATE, '%Y-%m') AS Month, count(*) AS Total_Messages,
               {n("Message_Type = 'Parent to Teacher'")} AS Parent_Initiated,
               {n("Message_Type = 'Teacher to Parent'")} AS Teacher_Initiated,
               {n("Message_Type = 'Automated Reminder'")} AS Automated
        FROM key_communication GROUP BY 1""",
    # the joins below multiply facts by each other, as the questions were first asked
    "contact_vs_score": f"""
        SELECT CASE WHEN c.Student_ID IS NULL THEN 'No Communication' ELSE 'Has Communication' END
                 AS Communication_Status,
               count(DISTINCT s.Student_ID) AS Student_Count,
               {avg2("sum(p.Exam_Score)", "count(p.Exam_Score)")} AS Avg_Exam_Score
        FROM key_students s
        LEFT JOIN key_communication c ON s.Student_ID = c.Student_ID
        LEFT JOIN key_performance p ON s.Student_ID = p.Student_ID
        GROUP BY 1""",
    "contact_coverage_by_grade": f"""
        SELECT *, Total_Students - Students_With_Comms AS Silent_Students,
               {pct("Total_Students - Students_With_Comms", "Total_Students")} AS Silent_Pct
        FROM (SELECT s.Grade_Level, count(DISTINCT s.Student_ID) AS Total_Students,
                     count(DISTINCT c.Student_ID) AS Students_With_Comms
              FROM key_students s LEFT JOIN key_communication c ON s.Student_ID = c.Student_ID
              GROUP BY s.Grade_Level)""",
    "top5_contacted": f"""
        SELECT c.Student_ID, s.Full_Name, s.Grade_Level, count(*) AS Message_Count,
               {avg2("sum(p.Exam_Score)", "count(p.Exam_Score)")} AS Avg_Exam_Score
        FROM key_communication c
        JOIN key_students s ON c.Student_ID = s.Student_ID
        LEFT JOIN key_performance p ON c.Student_ID = p.Student_ID
        GROUP BY c.Student_ID, s.Full_Name, s.Grade_Level
        ORDER BY Message_Count DESC, c.Student_ID LIMIT 5""",
    "contacted_but_failing": f"""
        SELECT s.Student_ID, s.Full_Name, s.Grade_Level,
               {avg2("sum(p.Exam_Score)", "count(p.Exam_Score)")} AS Avg_Exam_Score,
               count(DISTINCT c.Date) AS Communication_Count
        FROM key_students s
        JOIN key_performance p ON s.Student_ID = p.Student_ID
        JOIN key_communication c ON s.Student_ID = c.Student_ID
        GROUP BY s.Student_ID, s.Full_Name, s.Grade_Level
        HAVING Avg_Exam_Score < 60""",
    "at_risk_fanout": f"""
        SELECT s.Student_ID, s.Full_Name, s.Grade_Level,
               {pct(n(PRESENT), "count(a.Student_ID)")} AS Attendance_Rate_Pct,
               {avg2("sum(p.Exam_Score)", "count(p.Exam_Score)")} AS Avg_Exam_Score,
               {n(MISSED)} AS Missed_Assignments,
               CASE WHEN max(c.Student_ID) IS NULL THEN 'No' ELSE 'Yes' END AS Has_Parent_Contact
        FROM key_students s
        LEFT JOIN key_attendance a ON s.Student_ID = a.Student_ID
        LEFT JOIN key_performance p ON s.Student_ID = p.Student_ID
        LEFT JOIN key_homework h ON s.Student_ID = h.Student_ID
        LEFT JOIN key_communication c ON s.Student_ID = c.Student_ID
        GROUP BY s.Student_ID, s.Full_Name, s.Grade_Level
        HAVING Attendance_Rate_Pct < 20 AND Avg_Exam_Score < 60 AND Missed_Assignments > 3""",
}

CLEANING = {
    f"clean_{t}": f"SELECT * FROM {t}"
    for t in ("students", "attendance", "homework", "performance", "communication")
}

CLEANING["clean_performance_negatives_null"] = """
    SELECT r.Student_ID, r.Subject, r.Exam_Score, r."Homework_Completion_%",
           CASE WHEN r.Subject IS NOT NULL THEN coalesce(r.positive, m.med) END AS CompletionRate
    FROM (SELECT *, CASE WHEN "Homework_Completion_%" <> '-5' THEN parsed END AS positive FROM parsed_performance) r
    LEFT JOIN (SELECT Subject, median(parsed) FILTER ("Homework_Completion_%" <> '-5') AS med
               FROM parsed_performance GROUP BY Subject) m ON r.Subject = m.Subject"""

FEATURES = {
    "student_summary": "SELECT * FROM student_summary",
    "at_risk": "SELECT * FROM student_summary WHERE Is_At_Risk",
}

FACTS = ("attendance", "homework", "performance", "communication")

# columns that cleaning keeps, per table
COLUMNS = {
    "students": ("Student_ID", "Full_Name", "Grade_Level", "Grade_Num", "Age"),
    "attendance": ("Student_ID", "Date", "Subject", "Attendance_Status", "Month"),
    "homework": ("Student_ID", "Subject", "Due_Date", "Status", "Guardian_Signature", "Grade_Feedback"),
    "performance": ("Student_ID", "Subject", "Exam_Score", "Homework_Completion_%", "CompletionRate"),
    "communication": ("Student_ID", "Date", "Message_Type", "Month"),
    "student_summary": (
        "Student_ID",
        "Full_Name",
        "Grade_Level",
        "Grade_Num",
        "Age",
        "Attendance_Rate_%",
        "HW_Completion_%",
        "Avg_Exam_Score",
        "Missed_Assignments",
        "Comm_Count",
        "Has_Communication",
        "Is_At_Risk",
        "Score_Band",
    ),
}
RAW_COLUMNS = {
    "students": 5,
    "attendance": 4,
    "homework": 7,
    "performance": 5,
    "communication": 4,
}


def _stack(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _raw_name(table: str) -> str:
    return "teacher_parent_communication" if table == "communication" else table


AUDIT = {
    "orphan_check": _stack(
        f"""SELECT '{t}' AS "table", count(DISTINCT coalesce(f.Student_ID, '')) AS orphans FROM {t} f
            WHERE NOT EXISTS (SELECT 1 FROM students s WHERE s.Student_ID = f.Student_ID)"""
        for t in FACTS
    ),
    "preview_communication": "SELECT Student_ID, Date, Message_Type, Month FROM communication ORDER BY ALL NULLS FIRST LIMIT 5",
    "preview_summary": "SELECT * FROM student_summary ORDER BY Student_ID NULLS FIRST, Full_Name NULLS FIRST LIMIT 5",
    "preview_students": "SELECT * FROM students ORDER BY Student_ID NULLS FIRST, Full_Name NULLS FIRST LIMIT 5",
    "raw_shapes": _stack(
        f"""SELECT '{_raw_name(t)}' AS "table", count(*) AS "rows", {width}::BIGINT AS "columns" FROM raw_{t}"""
        for t, width in RAW_COLUMNS.items()
    ),
    "clean_shapes": _stack(
        f"""SELECT '{t}' AS "table", count(*) AS "rows", {len(columns)}::BIGINT AS "columns" FROM {t}"""
        for t, columns in COLUMNS.items()
    ),
    "quality_report": "SELECT * FROM ("
    + _stack(
        [
            f"""SELECT '{t}' AS "table", count(*) AS "rows", {len(columns)}::BIGINT AS "columns",
                   '{c}' AS "column", count(*) - count("{c}") AS nulls FROM {t}"""
            for t, columns in COLUMNS.items()
            for c in columns
        ]
        + [
            f"""SELECT 'raw_homework' AS "table", count(*) AS "rows", 7::BIGINT AS "columns",
                   'Guardian_Signature unknown' AS "column",
                   {n("trim(Guardian_Signature) NOT IN ('Yes', 'No', '')")} AS nulls FROM raw_homework"""
        ]
    )
    + ") WHERE nulls > 0",
    "unmapped_counts": _stack(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS "rows", count(*) - count({read}) AS nulls
            FROM {source}"""
        for t, c, read, source in (
            (
                "students",
                "Date_of_Birth",
                "coalesce(try_strptime(Date_of_Birth, '%Y-%m-%d'), try_strptime(Date_of_Birth, '%m-%d-%Y'))",
                "raw_students",
            ),
            ("attendance", "Attendance_Status", "Attendance_Status", "attendance"),
            ("homework", "Status", "Status", "homework"),
            ("homework", "Due_Date", "Due_Date", "homework"),
            ("performance", "CompletionRate", "CompletionRate", "performance"),
            ("parsed_performance", "Exam_Score", "Exam_Score", "raw_performance"),
            (
                "parsed_performance",
                "Homework_Completion_% unreadable",
                """CASE WHEN coalesce(trim("Homework_Completion_%"), '') = '' THEN 0
                   ELSE try_cast(replace("Homework_Completion_%", '%', '') AS DOUBLE) END""",
                "raw_performance",
            ),
        )
    ),
    "status_value_counts": _stack(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", {c}::VARCHAR AS label, count(*) AS n FROM {t}
            WHERE {c} IS NOT NULL GROUP BY {c}"""
        for t, c in (
            ("attendance", "Attendance_Status"),
            ("homework", "Status"),
            ("homework", "Guardian_Signature"),
        )
    ),
    "completion_rate_by_subject": f"""
        SELECT Subject, {even("sum(CompletionRate::DECIMAL(20,12))::DOUBLE / count(CompletionRate)", 3)} AS Mean_CompletionRate
        FROM performance WHERE Subject IS NOT NULL GROUP BY Subject""",
}

TWO_DIGITS = 'round("{}" * 100)::BIGINT'


def _mean_of_rounded(column: str) -> str:
    h = TWO_DIGITS.format(column)
    return avg2(f"sum({h})", f"100 * count({h})")


DASHBOARD = {
    "kpi_executive": f"""
        SELECT (SELECT count(*) FROM students) AS Total_Enrollment,
               (SELECT {avg2("sum(Exam_Score)", "count(Exam_Score)")} FROM parsed_performance) AS Avg_Score,
               (SELECT {n("Is_At_Risk")} FROM student_summary) AS At_Risk_Count,
               (SELECT {pct(n("Attendance_Status = 'Present'"), "count(*)")} FROM attendance) AS Attendance_Rate_Pct,
               (SELECT {pct(n("Status = 'Done'"), "count(*)")} FROM homework) AS HW_Completion_Rate_Pct""",
    "student_score_bands": "SELECT Score_Band, count(*) AS Students FROM student_summary GROUP BY Score_Band",
    "at_risk_by_grade": f"SELECT Grade_Level, {n('Is_At_Risk')} AS At_Risk FROM student_summary GROUP BY Grade_Level",
    "monthly_attendance": f"""
        SELECT Month, count(*) AS Records, {pct(n("Attendance_Status = 'Present'"), "count(*)")} AS Present_Rate_Pct
        FROM attendance GROUP BY Month""",
    "kpi_attendance": f"""
        SELECT count(*) AS Records,
               {pct(n("Attendance_Status = 'Present'"), "count(*)")} AS Attendance_Rate_Pct,
               {pct(n("Attendance_Status = 'Absent'"), "count(*)")} AS Absence_Rate_Pct,
               {pct(n("Attendance_Status = 'Late'"), "count(*)")} AS Late_Rate_Pct,
               {pct(n("Attendance_Status = 'Left Early'"), "count(*)")} AS Left_Early_Rate_Pct
        FROM attendance""",
    "absence_tardiness_by_subject": f"""
        SELECT Subject, count(*) AS Records, {n("Attendance_Status = 'Absent'")} AS Absent_Count,
               {n("Attendance_Status = 'Late'")} AS Late_Count
        FROM attendance GROUP BY Subject""",
    "status_by_subject": "SELECT Subject, Attendance_Status, count(*) AS Records FROM attendance GROUP BY ALL",
    "avg_attendance_rate_by_grade": f"""
        SELECT Grade_Level, {_mean_of_rounded("Attendance_Rate_%")} AS Avg_Attendance_Rate
        FROM student_summary GROUP BY Grade_Level""",
    "kpi_homework": f"""
        SELECT count(*) AS Assignments, {pct(n("Status = 'Pending'"), "count(*)")} AS Pending_Rate_Pct,
               {pct(n("Status = 'Not Done'"), "count(*)")} AS Missed_Rate_Pct,
               {pct(n("Status = 'Done'"), "count(*)")} AS Completion_Rate_Pct
        FROM homework""",
    "completion_donut": _share("(SELECT * FROM homework WHERE Status IS NOT NULL)", "Status", "Status"),
    "completion_rate_by_subject_clean": f"""
        SELECT Subject, count(*) AS Assignments, {n("Status = 'Done'")} AS "Done",
               {pct(n("Status = 'Done'"), "count(*)")} AS Completion_Rate_Pct
        FROM homework GROUP BY Subject""",
    "kpi_scores": f"""
        SELECT min(Exam_Score) AS Min_Score, max(Exam_Score) AS Max_Score,
               {pct(n("Exam_Score < 60"), "count(Exam_Score)")} AS Failing_Rate_Pct,
               {n("Exam_Score >= 90")} AS High_Achievers
        FROM parsed_performance""",
    "score_by_subject_grade": f"""
        SELECT p.Subject, s.Grade_Level, {avg2("sum(p.Exam_Score)", "count(p.Exam_Score)")} AS Avg_Score
        FROM parsed_performance p JOIN students s ON p.Student_ID = s.Student_ID GROUP BY p.Subject, s.Grade_Level""",
    "score_histogram": """
        SELECT (40 + (Exam_Score - 40) // 10 * 10)::INT AS Bin_Start, count(*) AS Records
        FROM parsed_performance WHERE Exam_Score IS NOT NULL GROUP BY 1""",
    "kpi_contact": """
        SELECT (SELECT count(*) FROM communication) AS Total_Messages,
               (SELECT count(*) FROM students) AS Total_Students,
               (SELECT count(*) FROM students s
                WHERE NOT EXISTS (SELECT 1 FROM communication c WHERE c.Student_ID = s.Student_ID))
                 AS Silent_Students""",
    "silent_by_grade": """
        SELECT Grade_Level, count(*) AS Silent_Students FROM students s
        WHERE NOT EXISTS (SELECT 1 FROM communication c WHERE c.Student_ID = s.Student_ID) GROUP BY Grade_Level""",
    "message_volume_trend": """
        SELECT Month, Message_Type, count(*) AS Messages FROM communication GROUP BY Month, Message_Type""",
    "at_risk_cohort_kpi": f"""
        SELECT {n("Is_At_Risk")} AS At_Risk_Students,
               {avg2(f"sum({TWO_DIGITS.format('Avg_Exam_Score')}) FILTER (Is_At_Risk)",
                     "100 * count(Avg_Exam_Score) FILTER (Is_At_Risk)")} AS Avg_Score,
               {avg2(f"sum({TWO_DIGITS.format('Attendance_Rate_%')}) FILTER (Is_At_Risk)",
                     '100 * count("Attendance_Rate_%") FILTER (Is_At_Risk)')} AS Avg_Attendance_Rate,
               {pct(n("Is_At_Risk"), "count(*)")} AS At_Risk_Pct
        FROM student_summary""",
    "risk_scatter": 'SELECT Student_ID, "Attendance_Rate_%", Avg_Exam_Score, Is_At_Risk FROM student_summary',
    "at_risk_table": """
        SELECT Student_ID, Full_Name, Grade_Level, "Attendance_Rate_%", "HW_Completion_%", Avg_Exam_Score,
               Missed_Assignments, Comm_Count, Has_Communication, Score_Band
        FROM student_summary WHERE Is_At_Risk""",
}

SOURCES = {
    "csv_scan_homework": "SELECT * REPLACE (nullif(Status, 'n/a') AS Status) FROM raw_homework",
    "table_scan": """
        SELECT s.Grade_Level, h.Subject, count(*) AS Assignments
        FROM key_homework h JOIN key_students s ON h.Student_ID = s.Student_ID
        GROUP BY s.Grade_Level, h.Subject""",
    "export_clean": _stack(
        f"""SELECT '{t}' AS "table", count(*) AS "rows", {len(COLUMNS[t])}::BIGINT AS "columns",
               {" + ".join(f'count("{c}")' for c in COLUMNS[t])} AS filled FROM {t}"""
        for t in ("student_summary", *FACTS)
    ),
}


def oracle_queries(existing: Collection[str] = ()) -> dict[str, str]:
    """SQL by query name; views named in ``existing`` are not defined but expected as tables."""
    parts = STORY | CLEANING | FEATURES | AUDIT | DASHBOARD | SOURCES
    return {name: with_views(sql, existing) for name, sql in parts.items()}
