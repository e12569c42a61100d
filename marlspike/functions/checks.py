"""Validity of cells; a null is valid but for not_null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import matches


def not_null(c: Column) -> Column:
    return c.isNotNull()


def in_range(c: Column, low=None, high=None, floating: bool = False) -> Column:
    """Bounds are inclusive; NaN is outside of any bound."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (c >= F.lit(low))
    if high is not None:
        inside = inside & (c <= F.lit(high))
    if floating and (low is not None or high is not None):
        inside = inside & ~F.isnan(c)
    return F.coalesce(c.isNull() | inside, F.lit(True))


def matches_pattern(c: Column, pattern: str, regex: bool = False) -> Column:
    return F.coalesce(matches(c, pattern, regex), F.lit(True))
