"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import field_of
from ..functions.predicates import condition


def filter_rows(df: DataFrame, column: str | Column, operator: str | None = None, value=None) -> DataFrame:
    """Rows whose cell meets a condition; or any boolean column."""
    if isinstance(column, Column):
        return df.filter(column)
    field_of(df, column)
    return df.filter(condition(F.col(column), operator, value))


def sort_values(df: DataFrame, by: list[str] | str, ascending: bool | list[bool] = True, then: list[str] = ()) -> DataFrame:
    """Nulls come last ascending and first descending; `then` keeps ties in order."""
    by = [by] if isinstance(by, str) else list(by)
    up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    for c in by:
        if field_of(df, c).dataType.typeName() in ("map", "variant", "struct"):
            raise TypeError(f"Column '{c}' cannot be sorted")
    return df.orderBy(*[F.col(c).asc_nulls_last() if u else F.col(c).desc_nulls_first() for c, u in zip(by, up, strict=True)], *then)


def top_k(df: DataFrame, by: list[str] | str, k: int, ascending: bool = True) -> DataFrame:
    return sort_values(df, by, ascending).limit(k)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have; columns by name, nulls equal nulls."""
    return a.intersect(b.select(*a.columns))


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.subtract(b.select(*a.columns))


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
