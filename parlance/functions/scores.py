"""Labels, bins and rounding of scores between 0 and 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From the lowest scores to the highest.
SEVERITIES = ("Very Severe", "Severe", "Moderate", "Mild")


def severity_level(score: Column, closed: str = "right") -> Column:
    """0 to 3 by quarters of 100. ``right``: 25 is in the first, below 0 or above 100 is null; ``left``: 25 is in the second, no ends."""
    if closed == "right":
        return F.when((score < 0) | (score > 100), None).when(score <= 25, 0).when(score <= 50, 1).when(score <= 75, 2).when(score <= 100, 3)
    return F.when(score < 25, 0).when(score < 50, 1).when(score < 75, 2).when(score.isNotNull(), 3)


def severity(score: Column, closed: str = "right") -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), severity_level(score, closed))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int = 5) -> Column:
    """0 to ``bins`` - 1 over the observed range, right-closed, the lowest value in the first; 0 where all are equal."""
    width = (high - low) / bins
    return F.when(x.isNotNull(), F.when(width > 0, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((x - low) / F.when(width > 0, width)) - 1))).otherwise(0)).cast("int")


def to_score(prediction: Column) -> Column:
    """Rounded half to even and kept within 0 and 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.rint(prediction)))


def capped_for_short(prediction: Column, words: Column, seconds: Column | None = None) -> Column:
    """At most 40 where there are fewer than 10 words (and, if given, less than 5 seconds)."""
    short = words < 10 if seconds is None else (words < 10) & (seconds < 5)
    return F.when(short, F.least(prediction, F.lit(40.0))).otherwise(prediction)
