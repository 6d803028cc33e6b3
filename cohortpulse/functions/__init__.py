"""Column -> Column functions. All are built-in Spark expressions; none is a Python UDF."""

from cohortpulse.functions.bands import ENTITY_BANDS, RECORD_BANDS, band
from cohortpulse.functions.dates import age_by_days, age_by_year, month_label, month_start, parse_mixed_date
from cohortpulse.functions.rounding import exact_avg, exact_pct, half_even
from cohortpulse.functions.text import bit_text, lookup, percent_fraction, same_text, sql_upper_trim, strip, whole_number

__all__ = [
    "ENTITY_BANDS",
    "RECORD_BANDS",
    "age_by_days",
    "age_by_year",
    "band",
    "bit_text",
    "exact_avg",
    "exact_pct",
    "half_even",
    "lookup",
    "month_label",
    "month_start",
    "parse_mixed_date",
    "percent_fraction",
    "same_text",
    "sql_upper_trim",
    "strip",
    "whole_number",
]
