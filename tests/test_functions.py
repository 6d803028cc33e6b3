"""Column functions on the edge rows of FIXTURES.md."""

from datetime import date
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortpulse.functions import (
    ENTITY_BANDS,
    RECORD_BANDS,
    age_by_days,
    age_by_year,
    band,
    bit_text,
    exact_avg,
    exact_pct,
    half_even,
    lookup,
    month_label,
    parse_mixed_date,
    percent_fraction,
    same_text,
    sql_upper_trim,
    strip,
    whole_number,
)
from cohortpulse.functions.text import UNICODE_SPACES
from cohortpulse.plans.features import is_at_risk
from cohortpulse.plans.labels import ATTENDANCE_LABEL, HOMEWORK_LABEL
from tests.helpers import apply


def test_strip_removes_what_python_strips(spark):
    values = ["\t S1 \n", "\xa0S1\xa0", "S1", "", " ", "x", None, "✅ ", "  a b　", "\x1cS\x1f", "é "]
    assert apply(spark, values, "string", strip) == [v if v is None else v.strip() for v in values]


def test_space_characters_are_all_of_them():
    assert set(UNICODE_SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_sql_upper_trim_keeps_tabs(spark):
    assert apply(spark, [" late", "absnt ", "\tx", None], "string", sql_upper_trim) == ["LATE", "ABSNT", "\tX", None]


def test_same_text_ignores_case_and_trailing_spaces(spark):
    values = ["Parent to Teacher", "parent to teacher  ", " Parent to Teacher", None]
    assert apply(spark, values, "string", lambda c: same_text(c, "Parent to Teacher")) == [True, True, False, None]


@pytest.mark.parametrize(
    "raw, label",
    [
        (" late", "Late"),
        ("Late", "Late"),
        ("absnt", "Absent"),
        ("ABSENT", "Absent"),
        ("PRESENT", "Present"),
        ("Left Early", "Left Early"),
        ("Excused", "Excused"),
        ("unknwn", None),
        (None, None),
    ],
)
def test_attendance_labels(spark, raw, label):
    assert apply(spark, [raw], "string", lambda c: lookup(F.upper(strip(c)), ATTENDANCE_LABEL)) == [label]


def test_homework_labels_are_case_sensitive(spark):
    given = ["✔", "✅", " Done ", "❌", "not done", "pending", "DONE", "Pending", "n/a", None]
    expected = ["Done"] * 3 + ["Not Done"] * 2 + ["Pending"] + [None] * 4
    assert apply(spark, given, "string", lambda c: lookup(strip(c), HOMEWORK_LABEL)) == expected


def test_bit_text(spark):
    assert apply(spark, ["Yes", "No", " ", "", None], "string", bit_text) == ["1", "0", None, None, None]
    assert apply(spark, [True, False, None], "boolean", bit_text) == ["1", "0", None]


def test_percent_fraction(spark):
    given = ["95", "95%", "0.4", "1", "1%", "105%", "-5", None, "nan", "many", "95d", "95f", " 95 % ", "9.5e1", "inf"]
    expected = [0.95, 0.95, 0.4, 1.0, 1.0, 1.05, 0.5, None, None, None, None, None, 0.95, 0.95, None]
    assert apply(spark, given, "string", percent_fraction) == expected
    assert apply(spark, ["-5", "95"], "string", lambda c: percent_fraction(c, "null")) == [None, 0.95]
    with pytest.raises(ValueError):
        percent_fraction(F.col("v"), "zero")


def test_whole_number(spark):
    given = ["60", "60.0", " 60 ", "60.", "-5", "60.5", "60d", "", "x", None, "99999999999"]
    assert apply(spark, given, "string", whole_number) == [60, 60, 60, 60, -5, None, None, None, None, None, None]
    assert apply(spark, [60, None], "int", whole_number) == [60, None]


def test_parse_other_date_forms(spark):
    day = date(2015, 3, 4)
    given = ["2015/03/04", "2015/3/4", "03/04/2015", "3/4/2015", "20150304", "March 4, 2015", "4 March 2015", "Mar 4 2015"]
    given += ["4-Mar-2015", "Mar. 4, 2015", "2015.03.04", "mar 04, 2015"]
    assert apply(spark, given, "string", parse_mixed_date) == [day] * len(given)
    bad = ["Marsh 4, 2015", "4 2015", "20151304", "2015/13/13", "March 44, 2015", "x/y/z", "2015/03-04", "March 2015"]
    assert apply(spark, bad, "string", parse_mixed_date) == [None] * len(bad)


def test_parse_mixed_date(spark):
    given = ["2015-03-04", "03-04-2015", "25-12-2015", " 2015-03-04 ", "junk", "", "13-13-2015", None]
    day = date(2015, 3, 4)
    assert apply(spark, given, "string", parse_mixed_date) == [
        day,
        day,
        date(2015, 12, 25),
        day,
        None,
        None,
        None,
        None,
    ]


def test_ages(spark):
    born = [date(2015, 3, 4), date(2014, 3, 31), None]
    # ten leap-free years of 365 days are over three days before the birthday
    assert apply(spark, born[:1], "date", lambda c: age_by_days(c, date(2025, 3, 1))) == [10]
    assert apply(spark, born, "date", lambda c: age_by_days(c, date(2025, 3, 31))) == [10, 11, None]
    assert apply(spark, born, "date", lambda c: age_by_year(c, date(2025, 1, 1))) == [10, 11, None]


def test_month_label(spark):
    assert apply(spark, [date(2024, 3, 9), None], "date", month_label) == ["2024-03", None]


def test_record_bands(spark):
    given = [59, 60, 74, 75, 89, 90, 100, 101, 110, None]
    names = ["Failing", "Average", "Average", "Good", "Good", "Excellent", "Excellent", "High", "High", "High"]
    assert [b.split()[0] for b in apply(spark, given, "int", lambda c: band(c, RECORD_BANDS))] == names


def test_entity_bands(spark):
    given = [59.99, 60.0, 74.99, 75.0, 90.0, None]
    expected = ["Failing", "Average", "Average", "Good", "Excellent", "Unknown"]
    assert apply(spark, given, "double", lambda c: band(c, ENTITY_BANDS)) == expected


def test_risk_rule(spark):
    given = [
        (19.99, 59.99, 4, True),
        (20.0, 59.0, 4, False),
        (19.0, 60.0, 4, False),
        (19.0, 59.0, 3, False),
        (None, 59.0, 4, False),
        (19.0, None, 4, False),
        (19.0, 59.0, None, False),
    ]
    df = spark.createDataFrame(given, "a double, s double, m bigint, expected boolean")
    assert df.filter(is_at_risk(F.col("a"), F.col("s"), F.col("m")) != F.col("expected")).count() == 0


def _half_up(value: Fraction) -> float:
    return int((value * 100 + Fraction(1, 2)) // 1) / 100


def test_exact_percent_is_rational_half_up(spark):
    pairs = [(n, d) for d in range(1, 121) for n in range(d + 1)] + [(201, 20000), (10**14, 3 * 10**14)]
    rows = [(n, d, _half_up(Fraction(100 * n, d))) for n, d in pairs]
    df = spark.createDataFrame(rows, "n bigint, d bigint, e double")
    assert df.filter(exact_pct(F.col("n"), F.col("d")) != F.col("e")).count() == 0
    assert df.select(exact_pct(F.lit(0), F.lit(0)).alias("x")).first().x is None


def test_exact_average_is_rational_half_up(spark):
    pairs = [(t, n) for n in range(1, 40) for t in range(40 * n, 40 * n + 60)]
    df = spark.createDataFrame([(t, n, _half_up(Fraction(t, n))) for t, n in pairs], "t bigint, n bigint, e double")
    assert df.filter(exact_avg(F.col("t"), F.col("n")) != F.col("e")).count() == 0


def test_half_even_equals_numpy(spark):
    values = [0.125, 2.675, 1.005, 0.285, None] + [n / d * 100 for d in range(1, 80) for n in range(d + 1)]
    expected = [v if v is None else float(np.round(np.array([v]), 2)[0]) for v in values]
    assert apply(spark, values, "double", half_even) == expected
    assert apply(spark, [0.0005, 0.7255], "double", lambda c: half_even(c, 3)) == [0.0, 0.726]
