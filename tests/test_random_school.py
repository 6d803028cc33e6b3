"""All queries against DuckDB on random raw tables that the derived ones do not resemble: repeated, unknown and
missing student ids, a student with a third of all rows, missing values in every column."""

import random
from datetime import date, timedelta

import duckdb
import pandas as pd
import pytest

from cohortpulse.oracle import oracle_queries
from cohortpulse.plans.registry import QUERIES, queries_over
from cohortpulse.sources.fixtures import LETTERS
from cohortpulse.sources.schemas import BRONZE
from cohortpulse.sources.tables import Tables
from tests.compare import differences

WRITING = {"csv_scan_homework", "table_scan", "export_clean"}
SUBJECTS = ["Math", "Arabic", "Science", None]


def _day(rng, us=False):
    day = date(2024, 1, 1) + timedelta(days=rng.randrange(200))
    return rng.choice([None, day.isoformat(), day.isoformat(), day.strftime("%m-%d-%Y") if us else day.isoformat()])


def _student(rng):
    if rng.random() < 0.33:
        return "S1"
    return rng.choice([None, "S9", *(f"S{i}" for i in range(2, 9))]) if rng.random() < 0.9 else f" S{rng.randrange(1, 9)} "


def _tables(seed):
    rng = random.Random(seed)
    pick = rng.choice
    students = [
        (pick(["", " "]) + f"S{i}", f"N{i}", pick(["Grade 1", "Grade 2", "Grade 9", None]), _day(rng, True), "5")
        for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 11)
    ]
    students += students[:3] * 3 + [(None, "nobody", "Grade 1", None, None), ("S2", "other name", "Grade 2", None, None)]
    status = ["PRESENT", "Present", " late", "Absent", "absnt ", "Left Early", "Excused", "unknwn", "absnt", None]
    return {
        "students": students,
        "attendance": [(_student(rng), _day(rng), pick(SUBJECTS), pick(status)) for _ in range(160)],
        "homework": [
            (
                _student(rng),
                "HW",
                pick(SUBJECTS),
                _day(rng, True),
                pick(["✔", "✅", " Done ", "DONE", "❌", "❌", "not done", "pending", "Pending", "n/a", None]),
                pick(["Yes", "No", " ", "", "maybe", None]),
                pick([*LETTERS, None]),
            )
            for _ in range(60)
        ],
        "performance": [
            (_student(rng), pick(SUBJECTS), pick([None, 40, 45, 59, 60, 75, 90, 100, 101]), rate, "t")
            for rate in (pick(["-5", "95", "95%", "0.4", "1%", "33.3", None]) for _ in range(40))
        ],
        "teacher_parent_communication": [
            (_student(rng), _day(rng), pick(["Teacher to Parent", "Parent to Teacher", "Automated Reminder"]), "m")
            for _ in range(25)
        ],
    }


@pytest.fixture(scope="module", params=[1, 2])
def school(request, spark):
    data = _tables(request.param)
    con = duckdb.connect()
    raw = {}
    for name, rows in data.items():
        columns = BRONZE[name]
        kinds = ["int" if c == "Exam_Score" else "string" for c in columns]
        raw[name] = spark.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds)))
        frame = pd.DataFrame(rows, columns=list(columns), dtype=object)
        typed = ", ".join(f'"{c}"::{"INTEGER" if k == "int" else "VARCHAR"} AS "{c}"' for c, k in zip(columns, kinds))
        short = "communication" if name == "teacher_parent_communication" else name
        con.register("frame", frame)
        con.execute(f"CREATE TABLE raw_{short} AS SELECT {typed} FROM frame")
    existing = {"raw_students", "raw_attendance", "raw_homework", "raw_performance", "raw_communication"}
    return queries_over(Tables(raw.__getitem__)), oracle_queries(existing), con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_random_school_equals_duckdb(school, name):
    queries, oracles, con = school
    assert differences(queries[name](), con, oracles[name]) == []
