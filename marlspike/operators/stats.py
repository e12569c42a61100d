"""Statistics of whole columns: one aggregation each, percentiles exact.

Spark's exact percentile holds all distinct values of a column in one task. Beyond small tables values are found by
their places instead (plans/places.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import NUMERIC, PLAIN, fresh, kind_of, need
from ..plans.order import SMALL_BYTES, is_small
from ..plans.places import values_at as found_at

MOMENTS = "Statistical operations only supported on numeric columns"
PAIRS = "Correlation only supported on numeric columns"
DESCRIBED = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if kind_of(f) in NUMERIC]


def at_place(c: str, n: int, k: int) -> Column:
    """The k-th smallest of n values, from 0, exactly."""
    return F.expr(f"percentile_disc({(k + 0.5) / n!r}D) WITHIN GROUP (ORDER BY `{c}`)").cast("double")


def values_at(df: DataFrame, c: str, places: list[int], n: int) -> dict[int, float]:
    """The values of a column at these places, from 0, of its n sorted cells that are not null."""
    found = found_at(df, [], F.col(c), [k / n for k in places], lambda _: [F.lit(k) for k in places])
    return dict(zip(places, found.first(), strict=True))


def between(n: int, q: float) -> tuple[int, int, float]:
    """(place below, place above, share of the one above) of a quantile of n values."""
    at = q * (n - 1)
    return int(at), min(int(at) + 1, n - 1), at - int(at)


def describe(df: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """statistic and a column for each numeric column. Quartiles are values at n/4 and 3n/4; the median is interpolated."""
    names = numeric_columns(df)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([(s,) for s in DESCRIBED], "statistic string")
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(names)]).first()
    parts, small = [], is_small(df, small_bytes)
    for i, c in enumerate(names):
        n, x = counts[i], F.col(c).cast("double")
        if n and not small:
            low, high, share = between(n, 0.5)
            at = values_at(df, c, sorted({n // 4, low, high, 3 * n // 4}), n)
            quarters = [F.lit(v) for v in (at[n // 4], at[low] * (1 - share) + at[high] * share, at[3 * n // 4])]
        else:
            quarters = [at_place(c, n, n // 4), F.median(x), at_place(c, n, 3 * n // 4)] if n else [F.lit(0.0)] * 3
        parts.append([F.lit(float(n)), *[F.coalesce(v, F.lit(0.0)) for v in (F.avg(x), F.stddev_pop(x), F.min(x), quarters[0], quarters[1], quarters[2], F.max(x))]])
    row = df.agg(*[F.array(*p).alias(f"v{i}") for i, p in enumerate(parts)])
    pos = row.select("*", F.posexplode(F.array(*map(F.lit, DESCRIBED))).alias("place", "statistic"))
    return pos.select("statistic", *[F.get(f"v{i}", F.col("place")).alias(c) for i, c in enumerate(names)])


def both(a: str, b: str) -> tuple[Column, Column]:
    """Cells of rows where neither is null."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def covariance(a: str, b: str) -> Column:
    return F.coalesce(F.covar_pop(*both(a, b)), F.lit(0.0))


def correlation(a: str, b: str) -> Column:
    x, y = both(a, b)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def matrix(df: DataFrame, cell) -> DataFrame:
    """column and a column for each numeric column; each pair is computed once."""
    names = numeric_columns(df)
    if not names:
        raise TypeError(PAIRS)
    at = {(i, j): cell(names[i], names[j]).alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i, len(names))}
    row = df.agg(*at.values())
    rows = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"c{min(i, j)}_{max(i, j)}").alias(m) for j, m in enumerate(names)]) for i, n in enumerate(names)])
    return row.select(F.inline(rows))


def corr(df: DataFrame) -> DataFrame:
    return matrix(df, correlation)


def cov(df: DataFrame) -> DataFrame:
    return matrix(df, covariance)


def pair_value(df: DataFrame, a: str, b: str, cell, strict: bool = False) -> float:
    for c in (a, b):
        need(df, c, NUMERIC, PAIRS)
    row = df.agg(cell(a, b).alias("v"), F.count(a).alias("m"), F.count(b).alias("n")).first()
    if strict and row["m"] != row["n"]:
        raise ValueError("Columns must have the same length")
    return row["v"]


def corr_with(df: DataFrame, a: str, b: str, strict: bool = False) -> float:
    return pair_value(df, a, b, correlation, strict)


def cov_with(df: DataFrame, a: str, b: str, strict: bool = False) -> float:
    return pair_value(df, a, b, covariance, strict)


def skewness(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.count(x) < 3, 0.0).otherwise(F.coalesce(F.skewness(x), F.lit(0.0)))


def excess_kurtosis(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.count(x) < 4, 0.0).otherwise(F.coalesce(F.kurtosis(x), F.lit(0.0)))


def skew(df: DataFrame, c: str) -> float:
    need(df, c, NUMERIC, MOMENTS)
    return df.agg(skewness(c)).first()[0]


def kurtosis(df: DataFrame, c: str) -> float:
    need(df, c, NUMERIC, MOMENTS)
    return df.agg(excess_kurtosis(c)).first()[0]


def quantile(df: DataFrame, c: str, q: float, small_bytes: int = SMALL_BYTES) -> float:
    if not 0.0 <= q <= 1.0:
        raise ValueError("Quantile must be between 0.0 and 1.0")
    need(df, c, NUMERIC, MOMENTS)
    if not is_small(df, small_bytes) and (n := df.agg(F.count(c)).first()[0]):
        low, high, share = between(n, q)
        at = values_at(df, c, sorted({low, high}), n)
        return at[low] * (1 - share) + at[high] * share
    found = df.agg(F.percentile(F.col(c).cast("double"), F.lit(q))).first()[0]
    if found is None:
        raise ValueError("Cannot calculate quantile for empty column")
    return found


def modes(df: DataFrame, c: str, order_by: list[str]) -> DataFrame:
    """The most frequent value; of several the one that reaches the count first."""
    n, last = fresh(df, "n_", "last_")
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(n), F.max(F.struct(*order_by)).alias(last))
    return counts.orderBy(F.desc(n), F.asc(last)).limit(1).select(F.col(c).alias("mode"))


def mode(df: DataFrame, c: str, order_by: list[str]):
    need(df, c, PLAIN, "Mode calculation not supported for this column type")
    row = modes(df, c, order_by).first()
    return row[0] if row else None


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Each value that is not null and its count."""
    (n,) = fresh(df, "count")
    return df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(n))


def nunique(df: DataFrame, c: str) -> int:
    need(df, c, PLAIN, "Unique count not supported for this column type")
    return df.agg(F.countDistinct(c)).first()[0]


# Numeric kernels: sample variance, zeros where there is nothing.
KERNELS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": lambda c: F.coalesce(F.avg(c), F.lit(0.0)),
    "min": lambda c: F.coalesce(F.min(c), F.lit(0)),
    "max": lambda c: F.coalesce(F.max(c), F.lit(0)),
    "variance": lambda c: F.coalesce(F.var_samp(c), F.lit(0.0)),
    "std_dev": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)),
}


def kernel(df: DataFrame, name: str, c: str):
    need(df, c, NUMERIC, MOMENTS)
    return df.agg(KERNELS[name](F.col(c))).first()[0]


def dot_product(df: DataFrame, a: str, b: str) -> float:
    return df.agg(F.coalesce(F.sum(F.col(a).cast("double") * F.col(b)), F.lit(0.0))).first()[0]


def add(a: Column, b: Column) -> Column:
    return a + b


def multiply(a: Column, b: Column) -> Column:
    return a * b


