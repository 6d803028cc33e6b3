"""Column lists of the raw (bronze), clean (silver) and feature (gold) tables."""

from __future__ import annotations

KEY = "Student_ID"

# Every raw column is read as a string: inferring types costs a pass and hides blanks.
BRONZE: dict[str, tuple[str, ...]] = {
    "students": (KEY, "Full_Name", "Grade_Level", "Date_of_Birth", "Emergency_Contact"),
    "attendance": (KEY, "Date", "Subject", "Attendance_Status"),
    "homework": (KEY, "Assignment_Name", "Subject", "Due_Date", "Status", "Guardian_Signature", "Grade_Feedback"),
    "performance": (KEY, "Subject", "Exam_Score", "Homework_Completion_%", "Teacher_Comments"),
    "teacher_parent_communication": (KEY, "Date", "Message_Type", "Message_Content"),
}

SILVER: dict[str, str] = {
    "students": f"{KEY} string, Full_Name string, Grade_Level string, Grade_Num int, Age int",
    "attendance": f"{KEY} string, Date date, Subject string, Attendance_Status string, Month string",
    "homework": f"{KEY} string, Subject string, Due_Date date, Status string, Guardian_Signature boolean, "
    "Grade_Feedback string",
    "performance": f"{KEY} string, Subject string, Exam_Score int, `Homework_Completion_%` string, "
    "CompletionRate double",
    "communication": f"{KEY} string, Date date, Message_Type string, Month string",
}

# Counts are 64-bit: one student may own a large part of a fact table.
GOLD: dict[str, str] = {
    "student_summary": f"{KEY} string, Full_Name string, Grade_Level string, Grade_Num int, Age int, "
    "`Attendance_Rate_%` double, `HW_Completion_%` double, Avg_Exam_Score double, Missed_Assignments bigint, "
    "Comm_Count bigint, Has_Communication boolean, Is_At_Risk boolean, Score_Band string",
}

# The tables handed to the dashboard, in the order they are written.
EXPORTED = ("student_summary", "attendance", "homework", "performance", "communication")
