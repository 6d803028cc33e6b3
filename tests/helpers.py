from datetime import date

from pyspark.sql import functions as F

from cohortpulse.sources.tables import Tables

AS_OF = date(2025, 3, 31)


def apply(spark, values, kind, change):
    """The values of ``change(column)`` for a column of ``values``, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.out for r in df.select("i", change(F.col("v")).alias("out")).orderBy("i").collect()]


def rows(df):
    return [tuple(r) for r in df.collect()]


def raw_school(spark, students=(), attendance=(), homework=(), performance=(), messages=()):
    """Raw tables from literal rows; only the columns the tests speak about are given."""
    schemas = {
        "students": (students, "Student_ID string, Full_Name string, Grade_Level string, Date_of_Birth string"),
        "attendance": (attendance, "Student_ID string, Date string, Subject string, Attendance_Status string"),
        "homework": (
            homework,
            "Student_ID string, Subject string, Due_Date string, Status string, Guardian_Signature string, "
            "Grade_Feedback string",
        ),
        "performance": (
            performance,
            "Student_ID string, Subject string, Exam_Score string, `Homework_Completion_%` string",
        ),
        "teacher_parent_communication": (messages, "Student_ID string, Date string, Message_Type string"),
    }
    return Tables(lambda name: spark.createDataFrame(list(schemas[name][0]), schemas[name][1]))


def final_plan(df):
    """The plan as executed, adaptive changes included."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def first_plan(df):
    """The plan before adaptive execution."""
    return df._jdf.queryExecution().executedPlan().toString()
