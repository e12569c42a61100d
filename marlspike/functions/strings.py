"""String functions over one column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def strip(c: Column) -> Column:
    """White space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def replace(c: Column, old: str, new: str) -> Column:
    if not old:
        raise ValueError("The text to replace must not be empty")
    return F.replace(c, F.lit(old), F.lit(new))


def split(c: Column, delimiter: str, as_array: bool = False) -> Column:
    """Parts joined by bars, or as an array."""
    if not delimiter:
        raise ValueError("The delimiter must not be empty")
    if as_array:
        return F.split(c, java_quote(delimiter), -1)
    return F.replace(c, F.lit(delimiter), F.lit("|"))


def java_quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def contains(c: Column, needle: str) -> Column:
    return F.contains(c, F.lit(needle))


def starts_with(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))


def ends_with(c: Column, suffix: str) -> Column:
    return F.endswith(c, F.lit(suffix))


def length(c: Column, unit: str = "bytes") -> Column:
    return (F.octet_length(c) if unit == "bytes" else F.char_length(c)).cast("bigint")


def matches(c: Column, pattern: str, regex: bool = False) -> Column:
    if regex:
        re.compile(pattern)
        return F.regexp_like(c, F.lit(pattern))
    return contains(c, pattern)
