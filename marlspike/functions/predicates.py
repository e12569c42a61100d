"""Filter conditions given by an operator's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _members(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


CONDITIONS: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "!=": lambda c, v: c.isNotNull() if v is None else c != F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "in": lambda c, v: c.isin(_members(v)),
    "not_in": lambda c, v: ~c.isin(_members(v)),
}


def condition(column: Column, operator: str, value) -> Column:
    """A null cell meets no condition but a comparison with None."""
    if operator not in CONDITIONS:
        raise ValueError(f"Unknown condition: {operator}")
    return CONDITIONS[operator](column, value)
