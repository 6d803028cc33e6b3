"""Banding of a number by upper limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bands:
    """``below``: (exclusive upper limit, label) in rising order; ``rest``: label above the last limit."""

    below: tuple[tuple[float, str], ...]
    rest: str
    missing: str


# Limits and labels of the two score scales.
# Records: scores are whole numbers, so "at most 100" is "below 101"; a missing score counts as High.
RECORD_BANDS = Bands(
    below=(
        (60, "Failing   (<60)"),
        (75, "Average   (60-74)"),
        (90, "Good      (75-89)"),
        (101, "Excellent (90-100)"),
    ),
    rest="High      (101-110)",
    missing="High      (101-110)",
)
# Entities: the mean score of one student.
ENTITY_BANDS = Bands(
    below=((60, "Failing"), (75, "Average"), (90, "Good")),
    rest="Excellent",
    missing="Unknown",
)


def band(c: Column, bands: Bands) -> Column:
    label = F.when(c.isNull(), bands.missing)
    for limit, name in bands.below:
        label = label.when(c < limit, name)
    return label.otherwise(bands.rest)
