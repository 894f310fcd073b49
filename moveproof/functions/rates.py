"""Percentages, growth rates and threshold labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places; 0.0 when there is no whole."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 2)).otherwise(F.lit(0.0))


def growth_rate(previous: Column, current: Column) -> Column:
    """Percent change; from nothing to nothing is 0.0, from nothing to something unknown."""
    return (
        F.when((previous == 0) & (current == 0), F.lit(0.0))
        .when(previous != 0, F.round(F.lit(100.0) * (current - previous) / previous, 2))
    )


def match_share(expected: Column, actual: Column) -> Column:
    """How much of the larger count the smaller one covers, in percent."""
    larger = F.greatest(expected, actual)
    return (
        F.when(expected > 0, F.round(F.lit(100.0) * F.least(expected, actual) / larger, 2))
        .when(actual == 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def cases(pairs) -> Column:
    """when/when/... over (condition, value) pairs, open for a final otherwise()."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def grade(value: Column, scale: tuple[list, object]) -> Column:
    """First label whose inclusive lower bound the value reaches, else the default."""
    steps, default = scale
    return cases((value >= bound, F.lit(label)) for bound, label in steps).otherwise(F.lit(default))
