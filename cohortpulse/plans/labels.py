"""Fixed values of the school data: raw spellings, clean labels, thresholds."""

from __future__ import annotations

from dataclasses import dataclass

# Grade names in order.
GRADE_NUMBER = {"Grade 1": 1, "Grade 2": 2, "Grade 3": 3, "Grade 4": 4, "Grade 5": 5}

# Upper-cased, trimmed attendance spelling -> clean label.
ATTENDANCE_LABEL = {
    "PRESENT": "Present",
    "ABSENT": "Absent",
    "ABSNT": "Absent",
    "LATE": "Late",
    "LEFT EARLY": "Left Early",
    "EXCUSED": "Excused",
}

# Stripped homework spelling -> clean label, case-sensitive.
HOMEWORK_LABEL = {
    "✔": "Done",
    "✅": "Done",
    "Done": "Done",
    "❌": "Not Done",
    "not done": "Not Done",
    "pending": "Pending",
}

# The story queries compare upper-cased, trimmed text.
SQL_ABSENT = ("ABSENT", "ABSNT")
SQL_DONE = ("DONE", "✔", "✅")
SQL_NOT_DONE = ("NOT DONE", "❌")

# Message types.
TO_PARENT = "Teacher to Parent"
TO_TEACHER = "Parent to Teacher"
AUTOMATED = "Automated Reminder"


@dataclass(frozen=True)
class RiskRule:
    """A student is at risk below the first two limits and above the third."""

    # The limits of the school.
    attendance: float = 20
    score: float = 60
    missed: int = 3


# A record or a mean below this is failing.
FAILING = 60

# Lowest exam score and histogram bin width; a high achiever is Excellent or High.
SCORE_FLOOR = 40
SCORE_BIN = 10
HIGH_ACHIEVER = 90
