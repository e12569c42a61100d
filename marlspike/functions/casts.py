"""Casts between the four plain kinds, without errors for bad cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import BOOL, FLOAT, INT, STR

#: Python types as targets of a cast.
TARGETS = {int: INT, float: FLOAT, str: STR, bool: BOOL}


def float_to_int(c: Column) -> Column:
    """Truncates, saturates at the ends of the range; NaN is 0."""
    return F.when(F.isnan(c), F.lit(0)).when(c >= F.lit(2.0**63), F.lit(2**63 - 1)).when(c <= F.lit(-(2.0**63)), F.lit(-(2**63))).otherwise(c.cast("bigint"))


def float_to_str(c: Column) -> Column:
    """Shortest decimal form without an exponent and without a trailing .0."""
    text = c.cast("string")
    digits = F.regexp_extract(text, r"^-?([0-9]+)\.([0-9]+)E(-?[0-9]+)$", 1)
    after = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9]+)\.([0-9]+)E(-?[0-9]+)$", 2), "^0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    large = F.concat(sign, digits, F.when(F.length(after) <= power, F.rpad(after, power, "0")).otherwise(F.concat(F.substring(after, F.lit(1), power), F.lit("."), F.substring(after, power + 1, F.length(after)))))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits, after)
    named = F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return named.when(F.regexp_like(text, F.lit("E-")), small).when(F.contains(text, F.lit("E")), large).otherwise(F.regexp_replace(text, r"\.0$", ""))


def cast(c: Column, source: str, target: str, nullable: bool) -> Column:
    """Cells of a column without nulls that cannot be read are zero, those of one with nulls are null."""
    if source == target:
        return c
    if source == STR and target == INT:
        read = F.when(F.regexp_like(c, F.lit(r"^[+-]?[0-9]+$")), c.try_cast("bigint"))
        return read if nullable else F.coalesce(read, F.lit(0))
    if source == STR and target == FLOAT:
        read = F.when(F.regexp_like(c, F.lit(r"^\S+$")) & ~F.regexp_like(c, F.lit(r"[dDfF]$")), c.try_cast("double"))
        return read if nullable else F.coalesce(read, F.lit(0.0))
    if source == STR:
        return F.length(c) > 0
    if target == BOOL:
        return c != 0
    if source == FLOAT and target == INT:
        return float_to_int(c.cast("double"))
    if source == FLOAT and target == STR:
        return float_to_str(c.cast("double"))
    return c.cast({INT: "bigint", FLOAT: "double", STR: "string"}[target])
