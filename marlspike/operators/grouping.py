"""Group-by aggregation: one shuffle with partial aggregates for any number of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import NUMERIC, STR, field_of, fresh, kind_of
from ..plans.order import SMALL_BYTES, growing, is_small
from ..plans.places import values_at

STRICT = "Only string columns can be used as group keys for now"


def checked_keys(df: DataFrame, keys: list[str] | str, strict: bool = False) -> list[str]:
    keys = [keys] if isinstance(keys, str) else list(keys)
    for k in keys:
        if k not in df.columns:
            raise KeyError(f"Key column '{k}' not found")
        if strict and kind_of(df.schema[k]) != STR:
            raise TypeError(STRICT)
    return keys


def aggregate(df: DataFrame, function: str, name: str | None = None, order_by: list[str] = (), strict: bool = False) -> Column:
    """count and size count rows, nulls too; std and var are those of a population; a sum of nothing is 0.

    Other than first and last, aggregates of a column that is not numeric are null, or a TypeError with strict.
    """
    if function in ("count", "size"):
        return F.count(F.lit(1)).alias(function)
    field, out = field_of(df, name), f"{name}_{function}"
    c = F.col(name)
    if function in ("first", "last"):
        if not order_by:
            raise ValueError("first and last need an order")
        key = F.struct(*order_by)
        return (F.min_by(c, key) if function == "first" else F.max_by(c, key)).alias(out)
    if function not in NUMERIC_AGGREGATES:
        raise ValueError(f"Unknown aggregation: {function}")
    if kind_of(field) not in NUMERIC:
        if strict:
            raise TypeError("Aggregation only supported on numeric columns")
        return F.max(F.lit(None).cast("double")).alias(out)
    return NUMERIC_AGGREGATES[function](c.cast("double")).alias(out)


NUMERIC_AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "median": F.median,
}


def medians(df: DataFrame, keys: list[str], name: str, small_bytes: int) -> DataFrame:
    """keys and {name}_median, without a group's values in one task. With very many groups counts of values get their places in
    the order of keys and values over the whole table, from which those of the groups before are taken off."""
    found = values_at(df, keys, F.col(name), [0.5], lambda n: [F.floor((n - 1) / 2), F.floor(n / 2)])
    if found is not None:
        return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], ((F.col("v0") + F.col("v1")) / 2).alias(f"{name}_median"))
    x, n, upto, total, groups = fresh(df.select(*keys), "x_", "n_", "upto_", "total_", "groups_")
    counts = df.filter(F.col(name).isNotNull()).groupBy(*keys, F.col(name).cast("double").alias(x)).agg(F.count(F.lit(1)).alias(n))
    placed = growing(counts, [*keys, x], {upto: F.col(n)}, small_bytes).alias("p")
    whole = growing(counts.groupBy(*keys).agg(F.sum(n).alias(total)), keys, {groups: F.col(total)}, small_bytes).alias("g")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.`{k}`").eqNullSafe(F.col(f"g.`{k}`"))
    last = F.col(upto) - (F.col(groups) - F.col(total))  # the place behind the last cell of this value, within the group
    holds = lambda k: ((last > k) & (last - F.col(n) <= k)).cast("int")
    weight = holds(F.floor((F.col(total) - 1) / 2)) + holds(F.floor(F.col(total) / 2))
    halves = placed.join(whole, same).select(*[F.col(f"p.`{k}`").alias(k) for k in keys], (F.col(x) * weight / 2).alias(x), weight.alias(n)).filter(F.col(n) > 0)
    return halves.groupBy(*keys).agg(F.sum(x).alias(f"{name}_median"))


def group_by(df: DataFrame, keys: list[str] | str, aggregates: list[tuple], order_by: list[str] = (), strict: bool = False, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """aggregates: (function,) or (function, column). Medians beyond small tables are found by places and joined."""
    keys = checked_keys(df, keys, strict)
    large = [a for a in aggregates if a[0] == "median" and keys and kind_of(field_of(df, a[1])) in NUMERIC]
    if large and not is_small(df, small_bytes):
        rest = [a for a in aggregates if a not in large] or [("count",)]
        out = df.groupBy(*keys).agg(*[aggregate(df, *a, order_by=order_by, strict=strict) for a in rest])
        for _, name in large:
            own = medians(df, keys, name, small_bytes)
            renamed = own.select(*[F.col(k).alias(f"{k} of {name}") for k in keys], f"{name}_median")
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`{k} of {name}`"))
            out = out.join(renamed, same, "left").drop(*[f"{k} of {name}" for k in keys])
        return out.select(*keys, *[a[0] if len(a) == 1 else f"{a[1]}_{a[0]}" for a in aggregates])
    return df.groupBy(*keys).agg(*[aggregate(df, *a, order_by=order_by, strict=strict) for a in aggregates])


def group_sum(df: DataFrame, keys: list[str] | str, name: str) -> DataFrame:
    """The sum under the column's own name."""
    if not keys:
        raise ValueError("At least one key column is needed")
    return group_by(df, keys, [("sum", name)]).withColumnRenamed(f"{name}_sum", name)


def group_mean(df: DataFrame, keys: list[str] | str, name: str, over_all_rows: bool = False) -> DataFrame:
    """The mean under the column's own name; over_all_rows counts nulls as rows."""
    if not keys:
        raise ValueError("At least one key column is needed")
    keys = checked_keys(df, keys)
    c = F.col(name).cast("double")
    return df.groupBy(*keys).agg((F.coalesce(F.sum(c), F.lit(0.0)) / F.count(F.lit(1)) if over_all_rows else F.avg(c)).alias(name))


def group_apply(df: DataFrame, keys: list[str] | str, func, schema) -> DataFrame:
    """func on the pandas frame of each group, which has to fit a task's memory."""
    return df.groupBy(*checked_keys(df, keys)).applyInPandas(func, schema)
