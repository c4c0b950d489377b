"""Derived metrics of components. A ratio with nothing below is 0, or 1 if there is something above."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abstractness(abstract: Column, total: Column) -> Column:
    return F.when(total == 0, F.when(abstract > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), abstract / total))


def instability(afferent: Column, efferent: Column) -> Column:
    return F.when(afferent + efferent == 0, 0.0).otherwise(efferent / (afferent + efferent))


def distance_main_sequence(abstractness: Column, instability: Column) -> Column:
    return F.abs(abstractness + instability - 1)


def nan_to_zero(c: Column) -> Column:
    return F.nanvl(c, F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, null where there is no whole."""
    return F.try_divide(part, whole) * 100


def age_in_days(now: Column, then: Column) -> Column:
    """Whole days between two times, either way round."""
    return F.floor(F.abs(F.unix_micros(now) - F.unix_micros(then)) / 86_400_000_000).cast("long")
