"""Dictionary encoding of string columns: each distinct value gets a dense number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import STR, need
from ..plans.order import SMALL_BYTES, indexed, is_small

STRINGS = "Dictionary encoding only supported on string columns"
ID_BYTES = 4


def dictionary(df: DataFrame, c: str, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """value and id of the distinct values: numbers from 0 in the order of the values. Nulls have none."""
    need(df, c, (STR,), STRINGS)
    values = df.select(F.col(c).alias("value")).filter("value IS NOT NULL").distinct()
    if is_small(values, small_bytes):
        return values.withColumn("id", (F.row_number().over(Window.orderBy("value")) - 1).cast("bigint"))
    return indexed(values, ["value"], "id")


def encode(df: DataFrame, c: str, codes: DataFrame) -> DataFrame:
    """df with {c}_id in the place of c; null where c is null or not in the dictionary."""
    own = codes.select(F.col("value").alias(f"value of {c}"), F.col("id").alias(f"{c}_id"))
    return df.join(own, F.col(c) == F.col(f"value of {c}"), "left").select(*[f"`{c}_id`" if x == c else f"`{x}`" for x in df.columns])


def decode(df: DataFrame, c: str, codes: DataFrame) -> DataFrame:
    """The strings again, where encode put their numbers."""
    own = codes.select(F.col("value").alias(c), F.col("id").alias(f"id of {c}"))
    return df.join(own, F.col(f"{c}_id") == F.col(f"id of {c}"), "left").select(*[f"`{c}`" if x == f"{c}_id" else f"`{x}`" for x in df.columns])


def savings(df: DataFrame, c: str) -> DataFrame:
    """One row: bytes of the strings, of the dictionary with a number for each cell, and what that saves."""
    need(df, c, (STR,), STRINGS)
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).select("n", F.octet_length(c).alias("length"))
    plain, encoded = F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0)), F.coalesce(F.sum(F.col("length") + ID_BYTES * F.col("n")), F.lit(0))
    return counts.agg(plain.cast("bigint").alias("plain_bytes"), encoded.cast("bigint").alias("encoded_bytes"), (plain - encoded).cast("bigint").alias("saved_bytes"))
