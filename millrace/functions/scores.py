"""Scores and durations of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_percent(logprob: Column) -> Column:
    """A log-probability on a scale of 0 to 100: one million to its power, capped at 1, times 100; null stays null."""
    scaled = 100 * F.least(F.greatest(F.pow(F.lit(1e6), logprob), F.lit(0.0)), F.lit(1.0))
    return F.when(logprob.isNotNull(), scaled)


def usable(x: Column) -> Column:
    """``x`` unless it is zero, NaN or infinite; cached and failed answers have a duration of 0."""
    return F.when((x != 0) & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(x: Column) -> Column:
    """``x`` unless it is NaN."""
    return F.when(~F.isnan(x), x)
