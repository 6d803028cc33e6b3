"""Checks of the school tables: references, nulls, label counts, shapes, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions import half_even, parse_mixed_date, percent_fraction, strip, whole_number
from cohortpulse.operators.aggregate import flag, value_counts
from cohortpulse.operators.fanout import fact_profile
from cohortpulse.operators.median import group_median
from cohortpulse.operators.quality import counts_report, orphan_counts, quoted, shape_report
from cohortpulse.operators.rank import top_n
from cohortpulse.plans.clean import clean_homework
from cohortpulse.plans.features import student_summary, summary_facts, with_features
from cohortpulse.sources.schemas import BRONZE, KEY
from cohortpulse.sources.tables import Tables

FACTS = ("attendance", "homework", "performance", "communication")
CLEAN = ("students", *FACTS)


def orphan_check(clean: Tables) -> DataFrame:
    """Fact ids that no student has, per fact."""
    facts = {name: clean["parsed_performance" if name == "performance" else name] for name in FACTS}
    return orphan_counts(clean["students"], KEY, facts)


def raw_shapes(raw: Tables) -> DataFrame:
    return shape_report({name: raw[name] for name in BRONZE})


def preview_students(clean: Tables, rows: int = 5) -> DataFrame:
    """The first students by id."""
    return top_n(clean["students"], rows, F.col(KEY).asc(), "Full_Name")


def preview_communication(clean: Tables, rows: int = 5) -> DataFrame:
    return top_n(clean["communication"], rows, F.struct(KEY, "Date").asc(), "Message_Type")


def preview_summary(clean: Tables, rows: int = 5) -> DataFrame:
    return top_n(student_summary(clean), rows, F.col(KEY).asc(), "Full_Name")


def clean_shapes(clean: Tables) -> DataFrame:
    """Filling gaps adds no rows, and the summary has those of the students, so neither is built to be counted."""
    counted = {name: clean["parsed_performance" if name == "performance" else name] for name in CLEAN}
    summary = student_summary(clean).columns
    students = clean["students"]
    widened = students.select(*[F.col(c) if c in students.columns else F.lit(None).alias(c) for c in summary])
    return shape_report({**counted, "student_summary": widened})


def quality_report(raw: Tables, clean: Tables) -> DataFrame:
    """Columns with nulls in the clean and the feature tables. Signature texts that are neither Yes, No nor
    blank have become False; they are listed as 'Guardian_Signature unknown' of the raw homework table.

    Null counts are further measures of the per-student sums that the features need anyway, so a fact is read and
    shuffled once for its own report and for the summary. Completion rates alone take another look: their gaps are
    filled, but for those without a subject or of a subject without any rate.
    """
    unknown = ~strip(F.col("Guardian_Signature")).isin("Yes", "No", "")
    homework = clean_homework(raw["homework"], unknown.alias("unknown"))
    tables = {**{name: clean[name] for name in ("attendance", "communication")}, "homework": homework}
    tables["performance"] = clean["parsed_performance"]
    columns = {name: [c for c in df.columns if c != "unknown"] for name, df in tables.items()}
    columns["students"] = clean["students"].columns
    facts = {}
    for name, (_, measures) in summary_facts(clean).items():
        nulls = {f"{name}_{i}": flag(quoted(c).isNull()) for i, c in enumerate(columns[name])}
        facts[name] = (tables[name], {**measures, **nulls})
    facts["homework"][1]["unknown"] = flag(F.col("unknown"))
    copies = clean["students"].groupBy(KEY).agg(
        F.count("*").alias("copies"),
        *(F.count_if(quoted(c).isNull()).alias(f"students_{i}") for i, c in enumerate(columns["students"])),
    )
    joined = with_features(copies.join(fact_profile(KEY, facts), KEY, "full"))
    features = student_summary(clean).columns
    own = {c: f"students_{i}" for i, c in enumerate(columns["students"])}
    counted = [F.sum(c).alias(c) for name in ("students", *facts) for c in (f"{name}_{i}" for i in range(len(columns[name])))]
    counted += [F.sum(f"n_{name}").alias(f"n_{name}") for name in facts] + [F.sum(c).alias(c) for c in ("copies", "unknown")]
    counted += [
        F.sum(F.when(quoted(c).isNull(), F.col("copies"))).alias(f"summary_{i}") for i, c in enumerate(features) if c not in own
    ]
    rates = clean["parsed_performance"].groupBy("Subject").agg(F.count("CompletionRate").alias("known"), F.count("*").alias("n"))
    lost = rates.agg(F.sum(F.when(F.col("Subject").isNull() | (F.col("known") == 0), F.col("n"))).alias("lost_rates"))
    totals = joined.agg(*counted).withColumn("lost_rates", lost.scalar())

    def entry(table: str, rows: str, width: int, column: str, nulls: str) -> Column:
        values = {"rows": F.coalesce(rows, F.lit(0)), "columns": F.lit(width).cast("bigint")}
        values |= {"column": F.lit(column), "nulls": F.coalesce(nulls, F.lit(0))}
        return F.struct(F.lit(table).alias("table"), *[v.alias(k) for k, v in values.items()])

    entries = []
    for name, rows in (("students", "copies"), *((name, f"n_{name}") for name in facts)):
        for i, c in enumerate(columns[name]):
            nulls = "lost_rates" if c == "CompletionRate" else f"{name}_{i}"
            entries.append(entry(name, rows, len(columns[name]), c, nulls))
    for i, c in enumerate(features):
        entries.append(entry("student_summary", "copies", len(features), c, own.get(c, f"summary_{i}")))
    entries.append(entry("raw_homework", "n_homework", len(raw["homework"].columns), "Guardian_Signature unknown", "unknown"))
    return totals.select(F.inline(F.array(*entries))).filter("nulls > 0").orderBy("table", "column")


def unmapped_counts(raw: Tables, clean: Tables) -> DataFrame:
    """Values that cleaning could not read, zeros included."""
    born = parse_mixed_date(F.col("Date_of_Birth"))
    percent = F.col("Homework_Completion_%")
    tables = {
        "students": (raw["students"], {"Date_of_Birth": born.isNull()}),
        "attendance": (clean["attendance"], {"Attendance_Status": F.col("Attendance_Status").isNull()}),
        "homework": (clean["homework"], {c: F.col(c).isNull() for c in ("Status", "Due_Date")}),
        "performance": (clean["performance"], {"CompletionRate": F.col("CompletionRate").isNull()}),
        "parsed_performance": (
            raw["performance"],
            {
                "Exam_Score": whole_number(F.col("Exam_Score")).isNull(),
                "Homework_Completion_% unreadable": (F.trim(percent) != "") & percent_fraction(percent).isNull(),
            },
        ),
    }
    return counts_report(tables).select("table", "column", "rows", "nulls")


def status_value_counts(clean: Tables) -> DataFrame:
    parts = {
        "attendance": value_counts(clean["attendance"], "Attendance_Status"),
        "homework": value_counts(clean["homework"], "Status", "Guardian_Signature"),
    }
    stacked = [df.select(F.lit(name).alias("table"), *df.columns) for name, df in parts.items()]
    return reduce(DataFrame.unionAll, stacked).orderBy("table", "column", F.desc("n"), "label")


def completion_rate_by_subject(clean: Tables) -> DataFrame:
    """Mean completion rate after the median fill, to three digits. The rows need no filling for that: each gap adds the
    median once. Rates are added as decimals, so the sum does not depend on the order of the rows."""
    exact = "decimal(20,12)"
    parsed = clean["parsed_performance"].where(F.col("Subject").isNotNull())
    sums = parsed.groupBy("Subject").agg(
        F.sum(F.col("CompletionRate").cast(exact)).alias("total"),
        F.count("CompletionRate").alias("known"),
        F.count("*").alias("rows"),
    )
    medians = group_median(parsed, "Subject", "CompletionRate").withColumnRenamed("Subject", "of")
    gaps = (F.col("rows") - F.col("known")).cast("decimal(18,0)") * F.col("median").cast(exact)
    mean = (F.col("total") + gaps).cast("double") / F.col("rows")
    return (
        sums.join(medians, F.col("Subject") == F.col("of"), "left")
        .select("Subject", half_even(mean, 3).alias("Mean_CompletionRate"))
        .orderBy("Subject")
    )
