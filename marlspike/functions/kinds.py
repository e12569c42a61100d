"""Kinds of columns: what an operator may take, told from the schema when the plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INT, FLOAT, STR, BOOL, MIXED, OBJECT, TIME, OTHER = "Int", "Float", "Str", "Bool", "Mixed", "PyObject", "DateTime", "Other"
MIXED_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("o", T.BinaryType()),
    ]
)
SPARK_TYPES = {INT: T.LongType(), FLOAT: T.DoubleType(), STR: T.StringType(), BOOL: T.BooleanType(), MIXED: MIXED_TYPE, OBJECT: T.BinaryType()}


def kind_of(field: T.StructField) -> str:
    t = field.dataType
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return STR
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.StructType) and t.fieldNames() == MIXED_TYPE.fieldNames():
        return MIXED
    if isinstance(t, T.BinaryType) and field.metadata.get("kind") == OBJECT:
        return OBJECT
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    return OTHER


def type_name(field: T.StructField) -> str:
    """Kind with an Opt prefix where nulls are allowed."""
    return ("Opt" if field.nullable else "") + kind_of(field)


def field_of(df: DataFrame, name: str) -> T.StructField:
    if name not in df.columns:
        raise KeyError(f"Column '{name}' not found")
    return df.schema[name]


def need(df: DataFrame, name: str, kinds: tuple[str, ...], message: str) -> T.StructField:
    field = field_of(df, name)
    if kind_of(field) not in kinds:
        raise TypeError(message)
    return field


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of an operator's own, which df lacks."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            name, k = f"{stem}{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


NUMERIC = (INT, FLOAT)
PLAIN = (INT, FLOAT, STR, BOOL)
