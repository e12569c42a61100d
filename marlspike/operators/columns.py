"""Projection, column management, casts and nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts
from ..functions.kinds import BOOL, FLOAT, INT, MIXED, OBJECT, PLAIN, STR, field_of, kind_of


def select(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        field_of(df, n)
    return df.select(*names)


def drop_columns(df: DataFrame, names: list[str] | str) -> DataFrame:
    names = [names] if isinstance(names, str) else list(names)
    for n in names:
        field_of(df, n)
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    field_of(df, old)
    if new in df.columns:
        raise ValueError(f"Column '{new}' already exists")
    return df.withColumnRenamed(old, new)


def cast_column(df: DataFrame, name: str, target: type) -> DataFrame:
    field = field_of(df, name)
    kind = kind_of(field)
    if kind in (MIXED, OBJECT):
        raise TypeError("Cannot cast Mixed or OptMixed columns containing fallback Python objects")
    if target not in casts.TARGETS:
        raise TypeError("Unsupported target type")
    if kind not in PLAIN:
        raise TypeError("Unsupported column type for casting")
    return df.withColumn(name, casts.cast(F.col(name), kind, casts.TARGETS[target], field.nullable))


PYTHON_KINDS = {bool: BOOL, int: INT, float: FLOAT, str: STR}


def fillna(df: DataFrame, value) -> DataFrame:
    """value: a scalar for all columns with nulls, or a dict by column. Types are checked before anything is filled."""
    if isinstance(value, dict):
        chosen = {n: v for n, v in value.items() if field_of(df, n)}
    else:
        chosen = {f.name: value for f in df.schema if f.nullable and kind_of(f) in (*PLAIN, MIXED)}
    made: dict[str, Column] = {}
    for n, v in chosen.items():
        kind = kind_of(df.schema[n])
        if kind == OBJECT or not df.schema[n].nullable:
            continue
        if kind == MIXED:
            made[n] = F.coalesce(F.col(n), mixed_literal(v))
            continue
        given = PYTHON_KINDS.get(type(v))
        if given != kind and not (kind == FLOAT and given == INT):
            raise TypeError(f"Column '{n}' holds {kind}, which cannot be filled with {type(v).__name__}")
        made[n] = F.coalesce(F.col(n), F.lit(v).cast(df.schema[n].dataType))
    return df.withColumns(made) if made else df


def mixed_literal(value) -> Column:
    kind = PYTHON_KINDS[type(value)]
    cell = {"i": None, "f": None, "s": None, "b": None} | {{INT: "i", FLOAT: "f", STR: "s", BOOL: "b"}[kind]: value}
    types = {"i": "bigint", "f": "double", "s": "string", "b": "boolean"}
    return F.struct(F.lit(kind).alias("kind"), *[F.lit(cell[k]).cast(t).alias(k) for k, t in types.items()], F.lit(None).cast("binary").alias("o"))


def dropna(df: DataFrame, name: str | None = None) -> DataFrame:
    """Rows with a null in a column, or in any; NaN is not null."""
    names = df.columns if name is None else [name]
    keep = F.lit(True)
    for n in names:
        field_of(df, n)
        keep = keep & F.col(n).isNotNull()
    return df.filter(keep)


def edit_column(df: DataFrame, name: str, func, returns: T.DataType | str) -> DataFrame:
    """func on each cell, nulls included; returns: the type of its results. Slower than an expression."""
    field_of(df, name)
    return df.withColumn(name, F.udf(func, returns)(F.col(name)))


def edit_column_vectorised(df: DataFrame, name: str, func, returns: T.DataType | str) -> DataFrame:
    """func on pandas series."""
    field_of(df, name)

    def whole(cells):
        return func(cells)

    import pandas as pd

    whole.__annotations__ = {"cells": pd.Series, "return": pd.Series}
    return df.withColumn(name, F.pandas_udf(whole, returns)(F.col(name)))


def isnull(df: DataFrame) -> DataFrame:
    """The same columns with true where a cell is null."""
    return df.select(*[F.col(c).isNull().alias(c) for c in df.columns])


def stringify(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def refine_nullability(df: DataFrame) -> DataFrame:
    """Scans once and marks columns without nulls as such."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    schema = T.StructType([T.StructField(f.name, f.dataType, bool(row[i]), f.metadata) for i, f in enumerate(df.schema)])
    return df.to(schema)
