"""Raw, key-stripped, clean and feature tables as common table expressions over the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Collection

AS_OF = "DATE '2025-03-31'"

SUBJECTS = "['Math','Arabic','Science','History','English','Geography']"


def _key(n: str) -> str:
    return f"'S' || lpad(({n})::VARCHAR, greatest(6, length(({n})::VARCHAR))::INT, '0')"


def pct(n: str, d: str) -> str:
    return f"((20000 * ({n})::HUGEINT + ({d})) // nullif(2 * ({d})::HUGEINT, 0))::DOUBLE / 100"


def avg2(total: str, n: str) -> str:
    return f"((200 * ({total})::HUGEINT + ({n})) // nullif(2 * ({n})::HUGEINT, 0))::DOUBLE / 100"


def even(x: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"round_even(({x}) * {scale}, 0) / {scale}"


def mixed_date(c: str) -> str:
    return f"coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m-%d-%Y'))::DATE"


CENTS = "round(o_totalprice * 100)::BIGINT"

VIEWS = {
    "raw_students": f"""
        SELECT (CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE '' END) || {_key("c_custkey")}
                 || (CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE '' END) AS Student_ID,
               c_name AS Full_Name,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Grade 1' WHEN 'BUILDING' THEN 'Grade 2'
                 WHEN 'FURNITURE' THEN 'Grade 3' WHEN 'HOUSEHOLD' THEN 'Grade 4'
                 WHEN 'MACHINERY' THEN 'Grade 5' END AS Grade_Level,
               CASE WHEN c_custkey % 10 = 0
                 THEN strftime(DATE '2005-01-01' + (c_custkey * 37 % 4745)::INT, '%m-%d-%Y')
                 ELSE strftime(DATE '2005-01-01' + (c_custkey * 37 % 4745)::INT, '%Y-%m-%d') END AS Date_of_Birth,
               '555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS Emergency_Contact
        FROM customer""",
    "raw_attendance": f"""
        SELECT {_key("o_custkey")} AS Student_ID,
               strftime(l_shipdate, '%Y-%m-%d') AS Date,
               {SUBJECTS}[(l_partkey % 6 + 1)::INT] AS Subject,
               CASE WHEN (l_partkey + l_linenumber) % 499 = 0 THEN 'unknwn'
                 ELSE ['PRESENT','Present',' late','Late','Absent','absnt','Left Early','Excused']
                      [((l_orderkey * 7 + l_partkey + l_linenumber * 3) % 8 + 1)::INT] END AS Attendance_Status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "raw_homework": f"""
        SELECT {_key("o_custkey")} AS Student_ID,
               'HW-' || (o_orderkey % 20)::VARCHAR AS Assignment_Name,
               {SUBJECTS}[(o_orderkey % 6 + 1)::INT] AS Subject,
               CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '%m-%d-%Y')
                 ELSE strftime(o_orderdate, '%Y-%m-%d') END AS Due_Date,
               CASE WHEN o_orderkey % 251 = 0 THEN 'n/a'
                 ELSE ['✔','✅',' Done ','❌','not done','pending'][({CENTS} % 6 + 1)::INT] END AS Status,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL
                 ELSE ['Yes','No',' '][(o_orderkey % 3 + 1)::INT] END AS Guardian_Signature,
               ['A+','A','B','B-','C','C-','D','F'][(o_orderkey % 8 + 1)::INT] AS Grade_Feedback
        FROM orders""",
    "raw_performance": f"""
        SELECT {_key("o_custkey")} AS Student_ID,
               CASE WHEN o_orderkey % 303 = 0 THEN NULL
                 ELSE {SUBJECTS}[((o_orderkey // 3) % 6 + 1)::INT] END AS Subject,
               (CASE WHEN o_custkey % 13 = 0 THEN 40 + {CENTS} % 13 ELSE 40 + {CENTS} % 71 END)::INT AS Exam_Score,
               CASE o_orderkey % 5 WHEN 0 THEN '-5'
                 WHEN 1 THEN (50 + o_orderkey % 51)::VARCHAR
                 WHEN 2 THEN (50 + o_orderkey % 51)::VARCHAR || '%'
                 WHEN 3 THEN '0.' || (10 + o_orderkey % 90)::VARCHAR END AS "Homework_Completion_%",
               'note ' || o_orderkey::VARCHAR AS Teacher_Comments
        FROM orders""",
    "raw_communication": f"""
        SELECT CASE WHEN event_type = 'signup' AND event_id % 50 = 0
                 THEN 'S9' || lpad(user_id::VARCHAR, greatest(5, length(user_id::VARCHAR))::INT, '0')
                 ELSE {_key("user_id")} END AS Student_ID,
               strftime(ts::DATE + (event_id % 180)::INT, '%Y-%m-%d') AS Date,
               CASE event_type WHEN 'click' THEN 'Teacher to Parent' WHEN 'view' THEN 'Parent to Teacher'
                 ELSE 'Automated Reminder' END AS Message_Type,
               'msg ' || event_id::VARCHAR AS Message_Content
        FROM events""",
    # the story queries: raw tables with stripped keys
    **{
        f"key_{t}": f"SELECT * REPLACE (trim(Student_ID) AS Student_ID) FROM raw_{t}"
        for t in ("students", "attendance", "homework", "performance", "communication")
    },
    # clean tables
    "students": f"""
        SELECT trim(Student_ID) AS Student_ID, Full_Name, Grade_Level,
               CASE Grade_Level WHEN 'Grade 1' THEN 1 WHEN 'Grade 2' THEN 2 WHEN 'Grade 3' THEN 3
                 WHEN 'Grade 4' THEN 4 WHEN 'Grade 5' THEN 5 END AS Grade_Num,
               (date_diff('day', {mixed_date("Date_of_Birth")}, {AS_OF}) // 365)::INT AS Age
        FROM raw_students""",
    "attendance": """
        SELECT trim(Student_ID) AS Student_ID, Date::DATE AS Date, Subject,
               CASE upper(trim(Attendance_Status)) WHEN 'PRESENT' THEN 'Present' WHEN 'ABSENT' THEN 'Absent'
                 WHEN 'ABSNT' THEN 'Absent' WHEN 'LATE' THEN 'Late' WHEN 'LEFT EARLY' THEN 'Left Early'
                 WHEN 'EXCUSED' THEN 'Excused' END AS Attendance_Status,
               strftime(Date::DATE, '%Y-%m') AS Month
        FROM raw_attendance""",
    "homework": f"""
        SELECT trim(Student_ID) AS Student_ID, Subject, {mixed_date("Due_Date")} AS Due_Date,
               CASE WHEN trim(Status) IN ('✔', '✅', 'Done') THEN 'Done'
                 WHEN trim(Status) IN ('❌', 'not done') THEN 'Not Done'
                 WHEN trim(Status) = 'pending' THEN 'Pending' END AS Status,
               coalesce(trim(Guardian_Signature) = 'Yes', false) AS Guardian_Signature,
               Grade_Feedback
        FROM raw_homework""",
    "parsed_performance": """
        SELECT trim(Student_ID) AS Student_ID, Subject, Exam_Score, "Homework_Completion_%",
               CASE WHEN p < 0 THEN abs(p) / 10 WHEN p <= 1 THEN p ELSE p / 100 END AS parsed
        FROM (SELECT *, try_cast(replace("Homework_Completion_%", '%', '') AS DOUBLE) AS p FROM raw_performance)""",
    "performance": """
        SELECT r.Student_ID, r.Subject, r.Exam_Score, r."Homework_Completion_%",
               CASE WHEN r.Subject IS NOT NULL THEN coalesce(r.parsed, m.med) END AS CompletionRate
        FROM parsed_performance r
        LEFT JOIN (SELECT Subject, median(parsed) AS med FROM parsed_performance GROUP BY Subject) m
          ON r.Subject = m.Subject""",
    "communication": """
        SELECT trim(Student_ID) AS Student_ID, Date::DATE AS Date, Message_Type,
               strftime(Date::DATE, '%Y-%m') AS Month
        FROM raw_communication""",
    "student_summary": f"""
        SELECT *, Comm_Count > 0 AS Has_Communication,
               coalesce("Attendance_Rate_%" < 20 AND Avg_Exam_Score < 60 AND Missed_Assignments > 3, false)
                 AS Is_At_Risk,
               CASE WHEN Avg_Exam_Score IS NULL THEN 'Unknown' WHEN Avg_Exam_Score < 60 THEN 'Failing'
                 WHEN Avg_Exam_Score < 75 THEN 'Average' WHEN Avg_Exam_Score < 90 THEN 'Good'
                 ELSE 'Excellent' END AS Score_Band
        FROM (
          SELECT s.*, a."Attendance_Rate_%", h."HW_Completion_%", p.Avg_Exam_Score,
                 coalesce(m.n, 0) AS Missed_Assignments, coalesce(c.n, 0) AS Comm_Count
          FROM students s
          LEFT JOIN (SELECT Student_ID, {even("count(*) FILTER (Attendance_Status = 'Present') / count(*) * 100")}
                       AS "Attendance_Rate_%" FROM attendance GROUP BY ALL) a USING (Student_ID)
          LEFT JOIN (SELECT Student_ID, {even("count(*) FILTER (Status = 'Done') / count(*) * 100")}
                       AS "HW_Completion_%" FROM homework GROUP BY ALL) h USING (Student_ID)
          LEFT JOIN (SELECT Student_ID, {even("avg(Exam_Score)")} AS Avg_Exam_Score
                       FROM parsed_performance GROUP BY ALL) p USING (Student_ID)
          LEFT JOIN (SELECT Student_ID, count(*) AS n FROM homework WHERE Status = 'Not Done' GROUP BY ALL) m
            USING (Student_ID)
          LEFT JOIN (SELECT Student_ID, count(*) AS n FROM communication GROUP BY ALL) c USING (Student_ID)
        )""",
}

_NAMES = re.compile(r"(?<![\w'])(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")(?![\w'])")


def with_views(query: str, existing: Collection[str] = ()) -> str:
    """The query behind a WITH clause of the views it uses, in an order that defines each before its use.

    Views named in ``existing`` are taken to be tables of the database.
    """
    order: list[str] = []

    def need(sql: str) -> None:
        for name in sorted(set(_NAMES.findall(sql))):
            if name not in order and name not in existing:
                need(VIEWS[name])
                order.append(name)

    need(query)
    heads = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in order)
    return f"WITH {heads}\n{query.strip()}" if order else query.strip()
