"""Date and time functions over text, epoch seconds or timestamps, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import INT, STR, TIME

# The accepted shapes of a time, and of a date without one.
SHAPE = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}|T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z?)$"
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "day_of_week": lambda ts: F.dayofweek(ts) - 1,
    "day_of_year": F.dayofyear,
}


def epoch(c: Column, kind: str, errors: str = "zero", date_only: str = "midnight") -> Column:
    """Seconds since 1970. What cannot be read is 0, or null with errors="null"."""
    if kind == STR:
        shape = F.regexp_like(c, F.lit(SHAPE))
        if date_only == "midnight":
            shape = shape | F.regexp_like(c, F.lit(DATE_SHAPE))
        seconds = F.floor(F.unix_millis(F.try_to_timestamp(F.when(shape, c))) / 1000).cast("bigint")
    elif kind == TIME:
        seconds = F.unix_seconds(c.cast("timestamp"))
    else:
        seconds = c.cast("bigint")
    return seconds if errors == "null" else F.coalesce(seconds, F.lit(0))


def part(seconds: Column, name: str) -> Column:
    """A component; all components of second 0 are 0, which stands for what could not be read."""
    return F.when(seconds == 0, F.lit(0)).otherwise(PARTS[name](F.timestamp_seconds(seconds))).cast("bigint")


def timestamp(c: Column, kind: str) -> Column:
    return epoch(c, kind, "null")


def timestamp_micros(c: Column) -> Column:
    """Of a native time, despite the name milliseconds since 1970, which is what this accessor stands for."""
    return F.unix_millis(c.cast("timestamp"))


def shifted(seconds: Column, by: int) -> Column:
    return F.date_format(F.timestamp_seconds(seconds + F.lit(by)), "yyyy-MM-dd HH:mm:ss")


KINDS = (STR, INT, TIME)
