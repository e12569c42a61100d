"""Rolling and expanding windows, ranks and changes over rows in the order of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import NUMERIC, PLAIN, fresh, need
from ..plans.order import SMALL_BYTES, growing, indexed, is_small, sliding

ROLLING = {"mean": F.avg, "sum": F.sum, "std": F.stddev_pop}
SALTS = 256
RANKS = ("average", "min", "max", "first", "dense")


def needs_order(order_by) -> list[str]:
    if not order_by:
        raise ValueError("This operator needs an order: pass order_by")
    return [order_by] if isinstance(order_by, str) else list(order_by)


def rolling(df: DataFrame, c: str, size: int, function: str, order_by, min_periods: int | None = None, partition_by: list[str] = (), small_bytes: int = SMALL_BYTES) -> DataFrame:
    """{c}_rolling_{function} over the last size rows; null with fewer than min_periods (size) cells that are not null."""
    need(df, c, NUMERIC, "Rolling operations only supported on numeric columns")
    if size < 1:
        raise ValueError("The window size must be at least 1")
    least, x = size if min_periods is None else min_periods, F.col(c).cast("double")

    def build(window) -> dict[str, Column]:
        frame = window.rowsBetween(-(size - 1), 0)
        return {f"{c}_rolling_{function}": F.when(F.count(x).over(frame) >= least, ROLLING[function](x).over(frame))}

    return sliding(df, needs_order(order_by), size - 1, build, partition_by, small_bytes)


def expanding(df: DataFrame, c: str, function: str, order_by, min_periods: int = 1, partition_by: list[str] = (), small_bytes: int = SMALL_BYTES) -> DataFrame:
    """{c}_expanding_{function}, mean or sum, over all rows so far."""
    need(df, c, NUMERIC, "Expanding operations only supported on numeric columns")
    x = F.col(c).cast("double")
    total, count = fresh(df, "sum_", "count_")
    made = growing(df, needs_order(order_by), {total: F.coalesce(x, F.lit(0.0)), count: F.when(x.isNull(), 0).otherwise(1)}, small_bytes, partition_by)
    value = F.col(total) if function == "sum" else F.col(total) / F.col(count)
    return made.withColumn(f"{c}_expanding_{function}", F.when(F.col(count) >= max(1, min_periods), value)).drop(total, count)


def rank(df: DataFrame, c: str, method: str = "average", order_by=(), small_bytes: int = SMALL_BYTES) -> DataFrame:
    """{c}_rank, ascending; nulls have none. first counts ties in the order of order_by."""
    if method not in RANKS:
        raise ValueError("Invalid ranking method. Must be one of: average, min, max, first, dense")
    need(df, c, NUMERIC, "Ranking only supported on numeric columns")
    x, out = F.col(c), f"{c}_rank"
    if is_small(df, small_bytes):
        by_value, of_value = Window.orderBy(x.asc_nulls_last()), Window.partitionBy(x)
        ties = F.count(F.lit(1)).over(of_value)
        value = {
            "average": lambda: F.rank().over(by_value) + (ties - 1) / 2.0,
            "min": lambda: F.rank().over(by_value),
            "max": lambda: F.rank().over(by_value) + ties - 1,
            "dense": lambda: F.dense_rank().over(by_value),
            "first": lambda: F.row_number().over(Window.orderBy(x.asc_nulls_last(), *needs_order(order_by))),
        }[method]()
        return df.withColumn(out, F.when(x.isNotNull(), value).cast("double"))
    if method == "first":
        (place,) = fresh(df, "place_")
        # nulls come first in the order of the index
        nulls = df.agg(F.count_if(x.isNull())).scalar()
        made = indexed(df, [c, *needs_order(order_by)], place)
        return made.withColumn(out, F.when(x.isNotNull(), F.col(place) - nulls + 1).cast("double")).drop(place)
    # counts of the distinct values, their running sums, and back
    value_, ties_, upto_, dense_ = fresh(df, "value_", "ties_", "upto_", "dense_")
    values = df.filter(x.isNotNull()).groupBy(x.alias(value_)).agg(F.count(F.lit(1)).alias(ties_))
    values = growing(values, [value_], {upto_: F.col(ties_), dense_: F.lit(1)}, small_bytes)
    joined = df.join(values, x == F.col(value_), "left")
    least = F.col(upto_) - F.col(ties_) + 1
    value = {"average": least + (F.col(ties_) - 1) / 2.0, "min": least, "max": F.col(upto_), "dense": F.col(dense_)}[method]
    return joined.withColumn(out, F.when(x.isNotNull(), value).cast("double")).drop(value_, ties_, upto_, dense_)


def pct_change(df: DataFrame, c: str, order_by, partition_by: list[str] = (), small_bytes: int = SMALL_BYTES) -> DataFrame:
    """{c}_pct_change: percent against the row before; null after a null or a zero."""
    need(df, c, NUMERIC, "Percentage change only supported on numeric columns")
    x = F.col(c).cast("double")

    def build(window) -> dict[str, Column]:
        before = F.lag(x).over(window)
        return {f"{c}_pct_change": F.when(before != 0, (x - before) / before * 100)}

    return sliding(df, needs_order(order_by), 1, build, partition_by, small_bytes)


def is_first(df: DataFrame, c: str, order_by, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """{c}_unique: false for later rows of a value; nulls are valid.

    Beyond small tables the rows of a value, and nulls, are cut into SALTS parts by their order keys: the first of
    each part is found there, and the first of a value among those of its parts, so that no task holds a frequent value.
    """
    need(df, c, PLAIN, "Uniqueness validation not supported for this column type")
    keys = needs_order(order_by)
    if is_small(df, small_bytes):
        return df.withColumn(f"{c}_unique", F.col(c).isNull() | (F.row_number().over(Window.partitionBy(c).orderBy(*keys)) == 1))
    part, first, every = fresh(df, "part_", "first_", "every_")
    own = df.withColumn(part, F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    own = own.withColumn(first, F.row_number().over(Window.partitionBy(c, part).orderBy(*keys)) == 1)
    own = own.withColumn(every, F.when(F.col(first), F.lit(-1)).otherwise(F.col(part)))
    among = F.row_number().over(Window.partitionBy(c, every).orderBy(*keys)) == 1
    return own.withColumn(f"{c}_unique", F.col(c).isNull() | (F.col(first) & among)).drop(part, first, every)
