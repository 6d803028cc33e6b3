"""Dates kept as text in more than one format, ages and month labels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortpulse.functions.text import aside

# English month names by their first three letters.
MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}


def parse_mixed_date(c: Column) -> Column:
    """Year-month-day, month-day-year or, failing that, day-month-year; null for anything else.

    Parts may be separated by '-', '/' or '.', or be one number of eight digits (year first); a month may be an English
    name or its first three letters ('March 4, 2015', '4 Mar 2015').

    The shape of a value, its length and where its first dash stands, picks the parser of the two usual forms. Other shapes
    are read :func:`aside` of the generated code.
    """
    dash_at = [(F.length(c) == 10) & (F.substring(c, i, 1) == "-") for i in (5, 3)]
    return F.coalesce(F.when(dash_at[0], c.try_cast("date")).when(dash_at[1], _either_order(*_cut(c))), aside(c, _any_shape))


def _as_date(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")


def _either_order(first: Column, second: Column, year: Column) -> Column:
    return F.coalesce(_as_date(year, first, second), _as_date(year, second, first))


def _cut(text: Column) -> list[Column]:
    return [F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, 4)]


def _any_shape(c: Column) -> Column:
    """Parts are reordered and cast rather than parsed with three patterns: a pattern that does not match
    raises and catches an exception per row inside Spark, a failed ``try_cast`` does not. Text with two-digit
    months and days is cut by position; only what is left after that is split.
    """
    text = F.trim(c)
    split = [F.split_part(text, F.lit("-"), F.lit(i)) for i in (1, 2, 3)]

    by_parts = F.when(F.length(text) == 10, _either_order(*_cut(text))).otherwise(_either_order(*split))
    other = F.when(text.rlike("^[0-9]{8}$"), _as_date(*(F.substring(text, a, n) for a, n in ((1, 4), (5, 2), (7, 2)))))
    other = other.when(text.rlike("^[0-9]+([/.])[0-9]+\\1[0-9]+$"), _separated(F.translate(text, "/.", "--")))
    other = other.when(text.rlike("[A-Za-z]{3}"), _named_month(F.lower(text)))
    return F.coalesce(c.try_cast("date"), by_parts, other)


def _separated(text: Column) -> Column:
    a, b, c = (F.split_part(text, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    return F.when(F.length(a) == 4, _as_date(a, b, c)).otherwise(_either_order(a, b, c))


def _named_month(text: Column) -> Column:
    name = F.regexp_extract(text, "^[^a-z]*([a-z]{3,9})\\.?[^a-z]*$", 1)
    months = F.create_map(*[F.lit(x) for item in MONTHS.items() for x in item])
    long_name = ["january", "february", "march", "april", "june", "july", "august", "september", "october", "november"]
    known = (F.length(name) == 3) | name.isin(*long_name, "december")
    day_last = F.regexp_extract(text, "^[a-z]+\\.? +([0-9]{1,2}),? +[0-9]{4}$", 1)
    day_first = F.regexp_extract(text, "^([0-9]{1,2})[ -][a-z]+\\.?,?[ -][0-9]{4}$", 1)
    day = F.when(day_last != "", day_last).when(day_first != "", day_first)
    return F.when(known, _as_date(F.substring(text, -4, 4), months[F.substring(name, 1, 3)], day))


def age_by_days(born: Column, as_of: date) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(F.lit(as_of), born) / 365).cast("int")


def age_by_year(born: Column, as_of: date) -> Column:
    """Difference of the calendar years alone."""
    return F.lit(as_of.year) - F.year(born)


def month_label(d: Column) -> Column:
    """'yyyy-MM'; null stays null."""
    return F.date_format(d, "yyyy-MM")


def month_start(d: Column) -> Column:
    """First day of the month: an integer-backed grouping key, to be labelled after the aggregation."""
    return F.trunc(d, "month")
