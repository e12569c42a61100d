"""Row order: what a frame's rows are sorted by, and windows over all rows that scale.

A window without partitions runs in one task. While a table is small, by the optimiser's estimate and by its rows, that is
the cheapest plan; beyond that the rows are cut into buckets of about BLOCK_ROWS by bounds sampled from the key, get a
dense index from the buckets' counts, and windows run in blocks of the index. Bounds are literals and the buckets' sums scalar
subqueries, not joins: where the columns made of them are not needed, as in the sample of a next operator, they fall away.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import fresh

SMALL_BYTES = 64 << 20
#: Estimates are those of compressed files: a window in one task has so many rows at most.
MOST_ROWS = 1 << 20
#: Bounds are one array, and sums of buckets one table, of this many entries at most.
MOST_BUCKETS = 1 << 14
BLOCK_ROWS = 100_000
SAMPLE_EACH = 40


SMALL_ROWS = 100_000
#: Estimates from here on mean that the optimiser does not know, as for local records.
UNKNOWN = 1 << 60


def estimated_bytes(df: DataFrame) -> int:
    """By the optimiser's statistics; by a count of rows where there are none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN:
        return size
    row = 8 + sum(f.dataType.jsonValue() == "string" and 32 or 12 for f in df.schema)
    return row * df.count()


def is_small(df: DataFrame, small_bytes: int = SMALL_BYTES) -> bool:
    """Whether a window over all rows may run in one task."""
    if small_bytes <= 0:
        return False
    # estimates of joins and groupings are far too high, those of files with few values far too low: rows are counted
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = MOST_ROWS if size <= small_bytes else SMALL_ROWS
    return df.limit(most + 1).count() <= most


def key_of(order_by) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def tie_break(df: DataFrame) -> list[Column]:
    """Behind a key: rows of equal keys come in one order however often they are read; only equal rows are interchangeable."""
    plain = [F.col(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    return [F.xxhash64(*plain)] if plain else []


def parts_of(c: Column, kind: T.DataType) -> list[Column]:
    """Columns of plain values in whose order structs are compared."""
    if not isinstance(kind, T.StructType):
        return [c]
    return [c.isNotNull(), *[part for f in kind for part in parts_of(c[f.name], f.dataType)]]


def bucketed(df: DataFrame, order_by: list[str], buckets: int | None, name: str) -> tuple[DataFrame, int]:
    """df with a column, below the number that is returned with it, that grows with the key: bounds come from a sample of about SAMPLE_EACH rows a bucket."""
    rows = df.count()
    buckets = buckets or min(MOST_BUCKETS, 1 + rows // BLOCK_ROWS)
    key = F.struct(*[part for c in order_by for part in parts_of(F.col(c), df.select(c).schema[0].dataType)])
    share = buckets * SAMPLE_EACH / max(1, rows)
    keys = df.select(key.alias("k"))
    sample = keys if share >= 1 else keys.filter(F.rand(7) < share)
    tiles = sample.select("k", F.ntile(buckets).over(Window.orderBy("k")).alias("t")).groupBy("t").agg(F.max("k").alias("k"))
    # found once: all plans that use them have the same bounds
    fine = [r["k"] for r in tiles.select("k").orderBy("k").collect()]
    # coarse bounds lead to a stretch of fine ones, so that a row looks at twice the root of the bounds
    stretch = max(1, math.isqrt(buckets))
    kind = df.select(F.array(key).alias("k")).schema["k"].dataType

    def held(steps: list) -> Column:
        rows = [F.struct(*map(F.lit, step)) for step in steps]
        return F.sort_array(F.array(*rows).cast(kind)) if rows else F.array().cast(kind)

    passed, key_ = fresh(df, "passed_", "key_")
    own = df.withColumn(key_, key).withColumn(passed, F.size(F.filter(held(fine[stretch - 1 :: stretch]), lambda b: b < F.col(key_))) * stretch)
    own = own.withColumn(name, F.col(passed) + F.size(F.filter(F.slice(held(fine), F.col(passed) + 1, F.lit(stretch)), lambda b: b < F.col(key_))))
    return own.drop(passed, key_), len(fine) + 1


def offsets(df: DataFrame, bucket: str, buckets: int, sums: dict[str, Column]) -> Column:
    """The struct, at a row's bucket, of the sums over all buckets before it: at most MOST_BUCKETS + 1 entries, with null before the first."""
    totals = df.groupBy(bucket).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias(bucket)).join(totals, bucket, "left")
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    entries = every.select(F.struct(bucket, *[F.sum(n).over(before).alias(n) for n in sums]).alias("e"))
    return F.get(entries.agg(F.sort_array(F.collect_list("e"))).scalar(), F.col(bucket))


def indexed(df: DataFrame, order_by: list[str], index: str, buckets: int | None = None) -> DataFrame:
    """df with the place of each row from 0 in the order of the key."""
    bucket, before = fresh(df, "bucket_", "before_")
    own, n = bucketed(df, order_by, buckets, bucket)
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(*order_by, *tie_break(df))) - 1
    placed = own.withColumn(index, place.cast("bigint") + F.coalesce(offsets(own, bucket, n, {before: F.lit(1)})[before], F.lit(0)))
    return placed.drop(bucket)


def sliding(df: DataFrame, order_by: list[str], before: int, build: Callable[[object], dict[str, Column]], partition_by: list[str] = (), small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Columns of build(window), whose frames reach back at most `before` rows."""
    if partition_by or is_small(df, small_bytes):
        return df.withColumns(build(Window.partitionBy(*partition_by).orderBy(*order_by)))
    index, block, halo = fresh(df, "index_", "block_", "halo_")
    size = max(BLOCK_ROWS, before)
    own = indexed(df, order_by, index).withColumn(block, F.floor(F.col(index) / size)).withColumn(halo, F.lit(False))
    back = own.filter(F.col(index) % size >= size - before).withColumn(block, F.col(block) + 1).withColumn(halo, F.lit(True))
    made = own.unionByName(back).withColumns(build(Window.partitionBy(block).orderBy(index)))
    return made.filter(~F.col(halo)).drop(block, halo, index)


def growing(df: DataFrame, order_by: list[str], sums: dict[str, Column], small_bytes: int = SMALL_BYTES, partition_by: list[str] = ()) -> DataFrame:
    """Running sums, from the first row, of non-null numeric expressions."""
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if partition_by or is_small(df, small_bytes):
        window = frame(Window.partitionBy(*partition_by).orderBy(*order_by))
        return df.withColumns({n: F.sum(c).over(window) for n, c in sums.items()})
    bucket, *before = fresh(df, "bucket_", *[f"before_{i}_" for i in range(len(sums))])
    own, n = bucketed(df, order_by, None, bucket)
    window = frame(Window.partitionBy(bucket).orderBy(*order_by, *tie_break(df)))
    passed = offsets(own, bucket, n, dict(zip(before, sums.values(), strict=True)))
    made = {n: F.sum(c).over(window) + F.coalesce(passed[b], F.lit(0)) for b, (n, c) in zip(before, sums.items(), strict=True)}
    return own.withColumns(made).drop(bucket)
