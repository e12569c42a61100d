"""Values at places of sorted cells, exactly, in two passes over the rows and without a sort of them.

A sketch of each group gives bounds around each place; the second pass counts the values between the bounds one by one and what
lies outside in stretches. Places that the bounds miss are looked for again between wider ones, at last between all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Shares of the rows around a place: the sketch is off by 1 / ACCURACY; 1 takes all values.
WIDTHS = (4 / ACCURACY, 256 / ACCURACY, 1.0)
MOST_GROUPS = 10_000


def values_at(df: DataFrame, keys: list[str], x: Column, shares: list[float], places) -> DataFrame | None:
    """For each group its keys, as k0, k1 and so on, and as v0, v1 and so on the values at places(n), from 0 and not far from shares of its n cells;
    None with more than MOST_GROUPS groups."""
    named = [f"k{i}" for i in range(len(keys))]
    cells = df.filter(x.isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], x.cast("double").alias("x"))
    if keys and cells.select(*named).distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        return None
    for width in WIDTHS:
        ends = [e for s in sorted(shares) for e in (max(0.0, s - width), min(1.0, s + width))]
        bounds = cells.groupBy(*named).agg(F.percentile_approx("x", ends, ACCURACY).alias("ends"), F.count("x").alias("total"))
        bounds = bounds.select(*[F.col(n).alias(f"own {n}") for n in named], "ends", "total")
        same = F.lit(True)
        for n in named:
            same = same & F.col(n).eqNullSafe(F.col(f"own {n}"))
        held = cells.join(F.broadcast(bounds), same)  # a row for each group, MOST_GROUPS at most
        low, high = [F.get("ends", F.lit(i)) for i in range(0, len(ends), 2)], [F.get("ends", F.lit(i)) for i in range(1, len(ends), 2)]
        inside, stretch = F.lit(False), F.lit(0)
        for a, b in zip(low, high, strict=True):
            inside, stretch = inside | ((F.col("x") >= a) & (F.col("x") <= b)), stretch + (F.col("x") > b).cast("int")
        counts = held.groupBy(*named, F.when(inside, F.col("x")).alias("v"), stretch.alias("s")).agg(F.count("x").alias("n"), F.min("x").alias("at"), F.first("total").alias("total"))
        upto = F.sum("n").over(Window.partitionBy(*named).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        hits = [F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("v")) for k in places(F.col("total"))]
        out = counts.withColumn("upto", upto).groupBy(*named).agg(*[F.max(h).alias(f"v{i}") for i, h in enumerate(hits)])
        table = out.toArrow()  # a row for each group
        if not any(table[f"v{i}"].null_count for i in range(len(hits))):
            return df.sparkSession.createDataFrame(table, out.schema)
    raise AssertionError("all values were counted")
