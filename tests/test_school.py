"""Cleaning, features and story queries on literal school rows."""

from datetime import date

from pyspark.sql import functions as F

from cohortpulse.plans import audit, clean, dashboard, features, story
from cohortpulse.plans.labels import RiskRule
from tests.helpers import AS_OF, raw_school, rows


def _clean(raw):
    return clean.clean_tables(raw, AS_OF)


def test_clean_students(spark):
    raw = raw_school(
        spark,
        students=[
            ("\tS1\xa0", "ann LEE", "Grade 3", "2015-03-04"),
            (" S2", "Bo", "Grade 9", "03-04-2015"),
            ("S3", None, None, "junk"),
        ],
    )
    assert rows(_clean(raw)["students"]) == [
        ("S1", "ann LEE", "Grade 3", 3, 10),
        ("S2", "Bo", "Grade 9", None, 10),
        ("S3", None, None, None, None),
    ]


def test_clean_homework(spark):
    raw = raw_school(
        spark,
        homework=[
            ("S1 ", "Math", "2024-05-06", " Done ", "Yes", "A"),
            ("S1", "Math", "05-06-2024", "❌", " ", None),
            ("S1", None, None, "DONE", None, "F"),
            ("S1", None, "x", None, "maybe", "F"),
        ],
    )
    day = date(2024, 5, 6)
    assert rows(_clean(raw)["homework"]) == [
        ("S1", "Math", day, "Done", True, "A"),
        ("S1", "Math", day, "Not Done", False, None),
        ("S1", None, None, None, False, "F"),
        ("S1", None, None, None, False, "F"),
    ]
    report = audit.quality_report(raw, _clean(raw))
    unknown = report.filter("column = 'Guardian_Signature unknown'").select("table", "rows", "nulls")
    assert rows(unknown) == [("raw_homework", 4, 1)]


def test_clean_performance_drops_rates_without_subject(spark):
    raw = raw_school(
        spark,
        performance=[
            ("S1", "Math", "40", "95%"),
            ("S1", "Math", "50", None),
            ("S1", None, "60", "80"),
            ("S2", "Arabic", None, "-5"),
        ],
    )
    found = {tuple(r) for r in _clean(raw)["performance"].select("Subject", "Exam_Score", "CompletionRate").collect()}
    assert found == {("Math", 40, 0.95), ("Math", 50, 0.95), (None, 60, None), ("Arabic", None, 0.5)}
    assert rows(audit.completion_rate_by_subject(_clean(raw))) == [("Arabic", 0.5), ("Math", 0.95)]


def test_months_of_missing_dates_are_null(spark):
    raw = raw_school(spark, messages=[("S1", "2024-03-09", "x"), ("S1", None, "x")])
    assert [r.Month for r in _clean(raw)["communication"].collect()] == ["2024-03", None]


def _risky(spark, **more):
    """S1 meets all three conditions, S2 has no attendance, S3 is fine, S4 has no facts at all."""
    return raw_school(
        spark,
        students=[(f" S{i}", f"N{i}", "Grade 1", "2015-01-01") for i in (1, 2, 3, 4)],
        attendance=[("S1", "2024-01-01", "Math", "absnt")] * 9
        + [("S1", "2024-01-01", "Math", "PRESENT"), ("S1", "2024-01-01", "Math", None)]
        + [("S3", "2024-01-01", "Math", " Present")],
        homework=[("S1", "Math", "2024-01-01", "❌", None, "F")] * 4
        + [("S2", "Math", "2024-01-01", "not done", None, "F")] * 5
        + [("S3", "Math", "2024-01-01", "✔", None, "F")],
        performance=[("S1", "Math", "40", None), ("S1", "Math", "59", None), ("S2", "Math", "41", None)],
        **more,
    )


def test_student_summary(spark):
    raw = _risky(spark, messages=[("S1", "2024-01-01", "x"), ("S9", "2024-01-01", "x")])
    found = {r.Student_ID: r for r in features.student_summary(_clean(raw)).collect()}
    assert len(found) == 4
    one, two, four = found["S1"], found["S2"], found["S4"]
    assert (one["Attendance_Rate_%"], one["HW_Completion_%"], one.Avg_Exam_Score) == (9.09, 0.0, 49.5)
    assert (one.Missed_Assignments, one.Comm_Count, one.Has_Communication, one.Is_At_Risk) == (4, 1, True, True)
    assert (two["Attendance_Rate_%"], two.Missed_Assignments, two.Is_At_Risk, two.Score_Band) == (None, 5, False, "Failing")
    assert (four.Avg_Exam_Score, four.Missed_Assignments, four.Comm_Count, four.Score_Band) == (None, 0, 0, "Unknown")
    assert not four.Has_Communication
    assert [r.Student_ID for r in features.at_risk(_clean(raw)).collect()] == ["S1"]
    assert features.at_risk(_clean(raw), RiskRule(attendance=9)).count() == 0
    keyed = story.with_stripped_keys(raw)
    assert story.at_risk_fanout(keyed, RiskRule(attendance=9)).count() == 0
    assert rows(audit.orphan_check(_clean(raw))) == [
        ("attendance", 0),
        ("homework", 0),
        ("performance", 0),
        ("communication", 1),
    ]


def test_executive_counts_unknown_students_in_rates_only(spark):
    raw = _risky(spark, messages=[])
    tables = _clean(raw)
    kpi = dashboard.kpi_executive(tables).first()
    assert (kpi.Total_Enrollment, kpi.At_Risk_Count, kpi.Avg_Score) == (4, 1, 46.67)
    assert (kpi.Attendance_Rate_Pct, kpi.HW_Completion_Rate_Pct) == (16.67, 10.0)
    cohort = dashboard.at_risk_cohort_kpi(tables).first()
    assert tuple(cohort) == (1, 49.5, 9.09, 25.0)


def _naive_at_risk(raw):
    """The join of all four facts, as first asked."""
    t = story.with_stripped_keys(raw)
    score = F.col("Exam_Score").cast("int")
    missed = F.count_if(story._homework().isin("NOT DONE", "❌"))
    return (
        t["students"]
        .join(t["attendance"].withColumn("a_id", F.col("Student_ID")).drop("Subject", "Date"), "Student_ID", "left")
        .join(t["performance"].drop("Subject"), "Student_ID", "left")
        .join(t["homework"].drop("Subject"), "Student_ID", "left")
        .join(t[story.COMMUNICATION].withColumn("c_id", F.col("Student_ID")).drop("Date"), "Student_ID", "left")
        .groupBy("Student_ID", "Full_Name", "Grade_Level")
        .agg(
            (F.count_if(story._attendance() == "PRESENT") / F.nullif(F.count("a_id"), F.lit(0)) * 100).alias("rate"),
            F.avg(score).alias("score"),
            missed.alias("missed"),
            F.max("c_id").isNotNull().alias("contact"),
        )
        .filter("rate < 20 AND score < 60 AND missed > 3")
    )


def test_at_risk_fanout_equals_naive_join(spark):
    twice = [(" S1", "N1", "Grade 1", "2015-01-01")]
    base = _risky(spark, messages=[("S1", "2024-01-01", "x")] * 3)
    doubled = base.map(
        lambda name, df: df.unionByName(spark.createDataFrame(twice, df.schema)) if name == "students" else df
    )
    for raw, expected in ((base, 4 * 11 * 2 * 3), (doubled, 2 * 4 * 11 * 2 * 3)):
        naive = _naive_at_risk(raw).first()
        found = rows(story.at_risk_fanout(story.with_stripped_keys(raw)))
        assert found == [("S1", "N1", "Grade 1", 9.09, 49.5, expected, "Yes")]
        assert (naive.missed, round(naive.rate, 2), naive.score) == (expected, 9.09, 49.5)


def test_contact_queries(spark):
    raw = story.with_stripped_keys(
        _risky(
            spark,
            messages=[
                ("S1", "2024-01-01", "Teacher to Parent"),
                ("S1", "2024-01-01", "parent to teacher "),
                ("S1", "2024-02-02", "Automated Reminder"),
                ("S4", "2024-02-02", "other"),
            ],
        )
    )
    assert set(rows(story.contact_vs_score(raw))) == {("Has Communication", 2, 49.5), ("No Communication", 2, 41.0)}
    assert rows(story.contact_coverage_by_grade(raw)) == [("Grade 1", 4, 2, 2, 50.0)]
    # three messages times two exams; a student without exams keeps the plain count
    assert rows(story.top5_contacted(raw)) == [("S1", "N1", "Grade 1", 6, 49.5), ("S4", "N4", "Grade 1", 1, None)]
    assert rows(story.contacted_but_failing(raw)) == [("S1", "N1", "Grade 1", 49.5, 2)]
    assert rows(story.monthly_message_volume(raw)) == [("2024-01", 2, 1, 1, 0), ("2024-02", 2, 0, 0, 1)]


def test_contact_weights_do_not_overflow(spark):
    """A student with as many messages and exams as fit: the weighted sums need more than 64 bits."""
    schema = "Student_ID string, copies bigint, n_messages bigint, score_sum bigint, scores bigint"
    profile = spark.createDataFrame([("S1", 1, 4 * 10**11, 75 * 10**12, 10**12)], schema)
    assert rows(story.contact_scores(profile)) == [("Has Communication", 1, 75.0)]


def test_having_compares_the_rounded_average(spark):
    scores = [("S1", "Math", "60", None)] * 249 + [("S1", "Math", "59", None)]  # 59.996
    raw = raw_school(
        spark,
        students=[("S1", "N", "Grade 1", None)],
        performance=scores,
        messages=[("S1", "2024-01-01", "x")],
    )
    assert rows(story.contacted_but_failing(raw)) == []


def test_signature_null_is_a_group(spark):
    raw = raw_school(
        spark,
        homework=[("S1", "Math", None, "Done", s, None) for s in ("Yes", "No", "No", " ", None)],
    )
    assert set(rows(story.completion_by_signature(raw))) == {("1", 1, 1, 100.0), ("0", 2, 2, 100.0), (None, 2, 2, 100.0)}


def test_missing_score_is_high_in_records(spark):
    raw = raw_school(spark, performance=[("S1", "Math", None, None), ("S1", "Math", "101", None)])
    assert rows(story.score_band_distribution(raw)) == [("High      (101-110)", 2, 100.0)]


def test_age_spread_takes_year_first_dates_only(spark):
    raw = raw_school(
        spark,
        students=[("S1", "a", "G", "2015-01-01"), ("S2", "b", "G", "2010-12-31"), ("S3", "c", "G", "01-01-1990")],
    )
    assert rows(story.age_spread_iso(raw, AS_OF)) == [("G", 10, 15, 12)]


def test_empty_tables(spark):
    raw = raw_school(spark)
    tables = _clean(raw)
    assert rows(features.student_summary(tables)) == []
    assert tuple(dashboard.kpi_executive(tables).first()) == (0, None, 0, None, None)
    assert tuple(dashboard.kpi_contact(tables).first()) == (0, 0, 0)
    assert rows(story.grade_distribution(raw)) == []
    assert rows(story.at_risk_fanout(raw)) == []
