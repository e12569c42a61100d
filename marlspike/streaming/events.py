"""Aggregates over unbounded input, and work in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import aggregate
from ..plans.order import estimated_bytes

DEFAULT_CHUNK_BYTES = 128 << 20


def windowed(stream: DataFrame, time: str, length: str, keys: list[str], aggregates: list[tuple], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by key and tumbling or sliding window; rows later than `late` behind the newest are left out on streams."""
    own = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    span = F.window(time, length, slide) if slide else F.window(time, length)
    out = own.groupBy(span.alias("w"), *keys).agg(*[aggregate(own, *a) for a in aggregates])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[tuple], late: str = "10 minutes") -> DataFrame:
    own = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = own.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[aggregate(own, *a) for a in aggregates])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def process_in_chunks(df: DataFrame, func: Callable, schema) -> DataFrame:
    """func on an iterator of pandas frames of each partition."""
    return df.mapInPandas(func, schema)


def estimate_memory(df: DataFrame) -> int:
    """Bytes by the optimiser's statistics."""
    return estimated_bytes(df)


def optimal_partitions(df: DataFrame, chunk_bytes: int = DEFAULT_CHUNK_BYTES) -> int:
    return max(1, -(-estimated_bytes(df) // chunk_bytes))
