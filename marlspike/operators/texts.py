"""String, date and validity operators: each appends a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks, datetimes, strings
from ..functions.kinds import FLOAT, NUMERIC, PLAIN, STR, kind_of, need
from ..plans.order import SMALL_BYTES, sliding
from .windows import needs_order

STRINGS = "String operations only supported on string columns"
TIMES = "Time series operations only supported on string or integer columns"
STRING_FUNCTIONS = {
    "upper": strings.upper,
    "lower": strings.lower,
    "strip": strings.strip,
    "replace": strings.replace,
    "split": strings.split,
    "contains": strings.contains,
    "len": strings.length,
    "starts_with": strings.starts_with,
    "ends_with": strings.ends_with,
}


def string_column(df: DataFrame, name: str, function: str, *args, **kw) -> DataFrame:
    """{name}_{function}; nulls stay null."""
    need(df, name, (STR,), STRINGS)
    return df.withColumn(f"{name}_{function}", STRING_FUNCTIONS[function](F.col(name), *args, **kw))


def str_cat(df: DataFrame, name: str, separator: str, order_by) -> DataFrame:
    """{name}_cat: all cells in order, joined, on every row. The joined text has to fit one row."""
    need(df, name, (STR,), STRINGS)
    keys = needs_order(order_by)
    cells = F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(*keys, F.col(name).alias("cell_")))))
    whole = df.agg(F.array_join(F.transform(cells, lambda c: c["cell_"]), separator).alias(f"{name}_cat"))
    return df.crossJoin(F.broadcast(whole))  # one row


def seconds(df: DataFrame, name: str, **options):
    field = need(df, name, datetimes.KINDS, TIMES)
    return datetimes.epoch(F.col(name), kind_of(field), **options)


def to_timestamps(df: DataFrame, name: str, **options) -> DataFrame:
    need(df, name, (STR,), "to_timestamps only supported on string columns")
    return df.withColumn(f"{name}_timestamp", seconds(df, name, **options))


def dt_part(df: DataFrame, name: str, part: str, **options) -> DataFrame:
    return df.withColumn(f"{name}_{part}", datetimes.part(seconds(df, name, **options), part))


def dt_shift(df: DataFrame, name: str, by: int = 0, hours: int = 0, days: int = 0, **options) -> DataFrame:
    return df.withColumn(f"{name}_shifted", datetimes.shifted(seconds(df, name, **options), by + 3600 * hours + 86400 * days))


def dt_diff(df: DataFrame, name: str, order_by, small_bytes: int = SMALL_BYTES, **options) -> DataFrame:
    """{name}_diff: seconds since the row before."""
    t = seconds(df, name, **options)
    return sliding(df, needs_order(order_by), 1, lambda w: {f"{name}_diff": t - F.lag(t).over(w)}, (), small_bytes)


def validate_not_null(df: DataFrame, name: str) -> DataFrame:
    need(df, name, PLAIN, "Validation not supported for this column type")
    return df.withColumn(f"{name}_not_null", checks.not_null(F.col(name)))


def validate_range(df: DataFrame, name: str, low=None, high=None) -> DataFrame:
    field = need(df, name, NUMERIC, "Range validation only supported for numeric columns")
    return df.withColumn(f"{name}_in_range", checks.in_range(F.col(name), low, high, kind_of(field) == FLOAT))


def validate_pattern(df: DataFrame, name: str, pattern: str, regex: bool = False) -> DataFrame:
    need(df, name, (STR,), "Pattern validation only supported for string columns")
    return df.withColumn(f"{name}_matches_pattern", checks.matches_pattern(F.col(name), pattern, regex))


def summary(df: DataFrame, name: str) -> DataFrame:
    """One row of counts as floats; the percentage of no rows is NaN."""
    need(df, name, PLAIN, "Validation summary not supported for this column type")
    total, filled = F.count(F.lit(1)).cast("double"), F.count(name).cast("double")
    share = F.coalesce(F.try_divide((total - filled) * 100, total), F.lit(float("nan")))
    return df.agg((total - filled).alias("null_count"), share.alias("null_percentage"), total.alias("total_count"), filled.alias("non_null_count"))


def validation_summary(df: DataFrame, name: str) -> dict[str, float]:
    return summary(df, name).first().asDict()


