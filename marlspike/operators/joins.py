"""Equi-joins with the frame's naming rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = "_right"


def checked_keys(left: DataFrame, right: DataFrame, left_on, right_on) -> tuple[list[str], list[str]]:
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = [right_on] if isinstance(right_on, str) else list(right_on)
    for c in lk:
        if c not in left.columns:
            raise KeyError(f"Left column '{c}' not found")
    for c in rk:
        if c not in right.columns:
            raise ValueError(f"Right column '{c}' not found")
    if len(lk) != len(rk):
        raise ValueError("Number of join columns must match")
    return lk, rk


def join(left: DataFrame, right: DataFrame, left_on, right_on, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """how: inner, left, right, outer, semi or anti.

    Inner and left keep the left keys; right keeps the right ones; outer keeps both, as one column where they
    have one name. Other columns of the right that clash get the suffix _right. Null keys match only with null_safe.
    """
    lk, rk = checked_keys(left, right, left_on, right_on)
    a, b = left.alias("l"), right.alias("r")
    cond: Column | None = None
    for x, y in zip(lk, rk, strict=True):
        p, q = F.col(f"l.`{x}`"), F.col(f"r.`{y}`")
        same = p.eqNullSafe(q) if null_safe else p == q
        cond = same if cond is None else cond & same
    joined = a.join(b, cond, {"outer": "full", "semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how in ("semi", "anti"):
        return joined
    pair = dict(zip(rk, lk, strict=True))
    columns: dict[str, Column] = {}
    if how == "right":
        columns = {c: F.col(f"l.`{c}`") for c in left.columns if c not in lk}
        for c in right.columns:
            columns[c if c not in columns else c + SUFFIX] = F.col(f"r.`{c}`")
    else:
        for c in left.columns:
            columns[c] = F.col(f"l.`{c}`")
        for c in right.columns:
            if c in pair and pair[c] == c:
                if how == "outer":
                    columns[c] = F.coalesce(F.col(f"l.`{c}`"), F.col(f"r.`{c}`"))
            elif c not in pair or how == "outer":
                columns[c if c not in columns else c + SUFFIX] = F.col(f"r.`{c}`")
    return joined.select(*[v.alias(k) for k, v in columns.items()])


def inner_join(left, right, left_on, right_on, **kw) -> DataFrame:
    return join(left, right, left_on, right_on, "inner", **kw)


def left_join(left, right, left_on, right_on, **kw) -> DataFrame:
    return join(left, right, left_on, right_on, "left", **kw)


def right_join(left, right, left_on, right_on, **kw) -> DataFrame:
    return join(left, right, left_on, right_on, "right", **kw)


def outer_join(left, right, left_on, right_on, **kw) -> DataFrame:
    return join(left, right, left_on, right_on, "outer", **kw)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product is what is asked for; names of the right that clash get the suffix."""
    for c in right.columns:
        if c in left.columns:
            right = right.withColumnRenamed(c, c + SUFFIX)
    return left.crossJoin(right)
