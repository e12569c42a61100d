"""Frames from Python records and back."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import BOOL, FLOAT, INT, MIXED, OBJECT, SPARK_TYPES, STR, kind_of

ORDER = "__ord"


def cell_kind(value) -> str:
    """A bool is never a number; what is no plain value is an object."""
    for kind, python in ((BOOL, bool), (INT, int), (FLOAT, float), (STR, str)):
        if isinstance(value, python):
            return kind
    return OBJECT


def column_kind(values: list) -> tuple[str, bool]:
    """(kind, nullable): the one kind of all cells, or Mixed; nothing but nulls is Mixed, other objects are objects."""
    kinds = {cell_kind(v) for v in values if v is not None}
    nullable = any(v is None for v in values)
    return (next(iter(kinds)) if len(kinds) == 1 else MIXED), nullable


def encode(value, kind: str):
    if value is None:
        return None
    if kind == OBJECT:
        return pickle.dumps(value)
    if kind != MIXED:
        return value
    own = cell_kind(value)
    cell = {INT: 1, FLOAT: 2, STR: 3, BOOL: 4, OBJECT: 5}[own]
    row = [own, None, None, None, None, None]
    row[cell] = pickle.dumps(value) if own == OBJECT else value
    return tuple(row)


def decode(value, kind: str):
    """Objects are unpickled: only for frames whose records come from a trusted place."""
    if value is None:
        return None
    if kind == OBJECT:
        return pickle.loads(value)
    if kind == MIXED:
        own = value["kind"]
        cell = value[{INT: "i", FLOAT: "f", STR: "s", BOOL: "b", OBJECT: "o"}[own]]
        return pickle.loads(cell) if own == OBJECT else cell
    return value


def from_dicts(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Columns are the keys of the first record; missing cells are null; ORDER keeps the rows' places."""
    if not records:
        raise ValueError("Input list is empty")
    names = list(records[0])
    fields, columns = [], []
    for name in names:
        values = [r.get(name) for r in records]
        kind, nullable = column_kind(values)
        fields.append(T.StructField(name, SPARK_TYPES[kind], nullable, {"kind": kind}))
        columns.append([encode(v, kind) for v in values])
    schema = T.StructType([*fields, T.StructField(ORDER, T.LongType(), False)])
    return spark.createDataFrame([(*row, i) for i, row in enumerate(zip(*columns, strict=True))] if names else [(i,) for i in range(len(records))], schema)


def as_records(df: DataFrame, order_by: list[str] = ()):
    """Iterator of row dicts in order; one partition at a time is held."""
    kinds = {f.name: kind_of(f) for f in df.schema if f.name != ORDER}
    names = list(kinds)
    for row in (df.orderBy(*order_by) if order_by else df).toLocalIterator():
        yield {n: decode(row[n], kinds[n]) for n in names}


def to_dicts(df: DataFrame, order_by: list[str] = (), lazy: bool = False):
    """List of row dicts in order, on the driver; with lazy an RDD of them, whose rows stay with the executors."""
    if not lazy:
        return list(as_records(df, order_by))
    kinds = {f.name: kind_of(f) for f in df.schema if f.name != ORDER}
    rows = (df.orderBy(*order_by) if order_by else df).rdd
    return rows.map(lambda row: {n: decode(row[n], kind) for n, kind in kinds.items()})


def to_variant(df: DataFrame, name: str) -> DataFrame:
    """A Mixed column of plain values as VARIANT."""
    c = F.col(name)
    text = F.coalesce(c["i"].cast("string"), c["f"].cast("string"), c["b"].cast("string"))
    quoted = F.regexp_extract(F.to_json(F.struct(c["s"].alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    return df.withColumn(name, F.try_parse_json(F.when(c.isNotNull(), F.coalesce(text, quoted))))
