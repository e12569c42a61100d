"""Frame: a DataFrame with an order of rows, and the operators as methods.

fillna, cast_column, edit_column, drop_columns and rename_column change the frame and return None; all
others return a new one. Nothing runs until rows, counts or values are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.kinds import field_of, type_name
from .operators import columns, dictionary, filters, grouping, joins, stats, texts, windows
from .plans.order import estimated_bytes
from .session import session
from .sources import records, tables


#: Rows that an operation which has to hold them on the driver takes; more are an error.
DRIVER_ROWS = 1_000_000


def bounded(df: DataFrame, what: str, instead: str) -> None:
    if df.limit(DRIVER_ROWS + 1).count() > DRIVER_ROWS:
        raise ValueError(f"{what} holds all rows on the driver, of which there are more than {DRIVER_ROWS}: {instead}")


class Col:
    """A column of a frame as it was when asked for."""

    def __init__(self, name: str, frame: Frame):
        self.name, self._frame = name, frame

    @property
    def type_str(self) -> str:
        return type_name(self._frame.df.schema[self.name])

    def __iter__(self) -> Iterator:
        return (r[self.name] for r in records.as_records(self._frame.df.select(self.name, *[c for c in self._frame.order_by if c != self.name]), self._frame.order_by))

    def __repr__(self) -> str:
        return f"Col(name='{self.name}', type={self.type_str})"


class Frame:
    def __init__(self, df: DataFrame | None = None, order_by: list[str] | str = ()):
        self.df = df if df is not None else session().createDataFrame([], T.StructType([]))
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)

    # sources and sinks
    @classmethod
    def from_dicts(cls, rows: list[dict], spark: SparkSession | None = None) -> Frame:
        return cls(records.from_dicts(spark or session(), rows), records.ORDER)

    @classmethod
    def from_pandas(cls, frame, spark: SparkSession | None = None) -> Frame:
        return cls.from_dicts(frame.astype(object).where(frame.notna(), None).to_dict("records"), spark)

    @classmethod
    def read(cls, path: str, format: str = "parquet", order_by=(), spark: SparkSession | None = None, **options) -> Frame:
        return cls(tables.read(spark or session(), path, format, **options), order_by)

    def write(self, path: str, format: str = "parquet", **options) -> None:
        tables.write(self.visible(), path, format, **options)

    def visible(self) -> DataFrame:
        return self.df.drop(records.ORDER)

    def to_dicts(self, lazy: bool = False):
        """A list of all rows on the driver; with lazy an RDD of the same dicts in the same order."""
        return records.to_dicts(self.df, self.order_by, lazy)

    def to_pandas(self):
        import pandas as pd

        return pd.DataFrame(self.to_dicts(), columns=self.columns)

    def __iter__(self) -> Iterator[dict]:
        return records.as_records(self.df, self.order_by)

    def head(self, n: int = 5) -> list[dict]:
        return Frame((self.df.orderBy(*self.order_by) if self.order_by else self.df).limit(n), self.order_by).to_dicts()

    def tail(self, n: int = 5) -> list[dict]:
        """The last n rows in order."""
        keys = [F.col(c).desc() for c in windows.needs_order(self.order_by)]
        return Frame(self.df.orderBy(*keys).limit(n), self.order_by).to_dicts()

    def memory_usage(self) -> int:
        """Bytes by the optimiser's statistics."""
        return estimated_bytes(self.df)

    def operation_count(self) -> int:
        """Operators of the optimised plan."""
        return len([x for x in self.df._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.strip()])

    def isnull(self) -> Frame:
        own = self.visible()
        kept = [c for c in self.order_by if c == records.ORDER]
        return self._new(self.df.select(*[F.col(c).isNull().alias(c) for c in own.columns], *kept), bool(kept))

    def value_counts(self, c: str) -> Frame:
        """Values and counts, the most frequent first."""
        counts = Frame(stats.value_counts(self.visible(), c))
        return counts.sort_values([counts.columns[-1], c], [False, True])

    def col(self, name: str) -> Col:
        field_of(self.visible(), name)
        return Col(name, Frame(self.df, self.order_by))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != records.ORDER]

    @property
    def dtypes(self) -> dict[str, str]:
        return {f.name: type_name(f) for f in self.visible().schema}

    @property
    def shape(self) -> tuple[int, int]:
        return self.len(), len(self.columns)

    def len(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def copy(self) -> Frame:
        return Frame(self.df, self.order_by)

    def __repr__(self) -> str:
        return f"Frame(columns={len(self.columns)}, cols={self.dtypes})"

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def _new(self, df: DataFrame, ordered: bool = True) -> Frame:
        return Frame(df, self.order_by if ordered else ())

    # changes in place
    def fillna(self, value) -> None:
        self.df = columns.fillna(self.df, value)

    def cast_column(self, name: str, target: type) -> None:
        self.df = columns.cast_column(self.df, name, target)

    def edit_column(self, name: str, func, returns: T.DataType | str | None = None) -> None:
        """Without a type, results are collected, of DRIVER_ROWS rows at most, and their kind is found as for records; with one it
        stays distributed."""
        if returns is not None:
            self.df = columns.edit_column(self.df, name, func, returns)
            return
        field_of(self.df, name)
        bounded(self.df, "edit_column without a type", "pass returns")
        rows = [r | {name: func(r[name])} for r in self]
        self.df, self.order_by = (records.from_dicts(self.df.sparkSession, rows), [records.ORDER]) if rows else (self.df, self.order_by)

    def drop_columns(self, names: list[str] | str) -> None:
        dropped = columns.drop_columns(self.df, names)
        if lost := set(self.order_by) - set(dropped.columns):
            raise ValueError(f"The frame is ordered by {sorted(lost)}")
        self.df = dropped

    def rename_column(self, old: str, new: str) -> None:
        self.df = columns.rename_column(self.df, old, new)
        self.order_by = [new if c == old else c for c in self.order_by]

    # rows
    def filter(self, column, operator: str | None = None, value=None) -> Frame:
        return self._new(filters.filter_rows(self.df, column, operator, value))

    def dropna(self, name: str | None = None) -> Frame:
        return self._new(columns.dropna(self.df, name))

    def sort_values(self, by, ascending=True) -> Frame:
        """The order of the new frame is by these columns, then by the old order."""
        ordered = filters.sort_values(self.df, by, ascending, self.order_by)
        # rows are sorted over all partitions: these numbers grow with them, whatever the size
        return Frame(ordered.withColumn(records.ORDER, F.monotonically_increasing_id()), records.ORDER)

    def select(self, *names: str) -> Frame:
        keep = [c for c in self.order_by if isinstance(c, str) and c not in names]
        return self._new(columns.select(self.df, *names, *keep))

    def union(self, *others: Frame) -> Frame:
        return self._new(filters.union(self.visible(), *[o.visible() for o in others]), False)

    concat = union

    def intersect(self, other: Frame) -> Frame:
        return self._new(filters.intersect(self.visible(), other.visible()), False)

    def except_rows(self, other: Frame) -> Frame:
        return self._new(filters.except_rows(self.visible(), other.visible()), False)

    def distinct(self) -> Frame:
        return self._new(filters.distinct(self.visible()), False)

    # dictionary encoding
    def dictionary(self, c: str) -> Frame:
        return Frame(dictionary.dictionary(self.df, c), "id")

    def encode(self, c: str, codes: Frame) -> Frame:
        return self._new(dictionary.encode(self.df, c, codes.visible()))

    def decode(self, c: str, codes: Frame) -> Frame:
        return self._new(dictionary.decode(self.df, c, codes.visible()))

    # joins
    def join(self, other: Frame, left_on, right_on, how: str = "inner", **kw) -> Frame:
        return Frame(joins.join(self.visible(), other.visible(), left_on, right_on, how, **kw))

    def inner_join(self, other, left_on, right_on, **kw) -> Frame:
        return self.join(other, left_on, right_on, "inner", **kw)

    def left_join(self, other, left_on, right_on, **kw) -> Frame:
        return self.join(other, left_on, right_on, "left", **kw)

    def right_join(self, other, left_on, right_on, **kw) -> Frame:
        return self.join(other, left_on, right_on, "right", **kw)

    def outer_join(self, other, left_on, right_on, **kw) -> Frame:
        return self.join(other, left_on, right_on, "outer", **kw)

    def cross_join(self, other: Frame) -> Frame:
        return Frame(joins.cross_join(self.visible(), other.visible()))

    def groupby(self, keys, strict: bool = False) -> GroupBy:
        return GroupBy(self, keys, strict)

    # statistics
    def describe(self) -> Frame:
        return Frame(stats.describe(self.visible()))

    def corr(self) -> Frame:
        return Frame(stats.corr(self.visible()))

    def cov(self) -> Frame:
        return Frame(stats.cov(self.visible()))

    def corr_with(self, a: str, b: str, **kw) -> float:
        return stats.corr_with(self.df, a, b, **kw)

    def cov_with(self, a: str, b: str, **kw) -> float:
        return stats.cov_with(self.df, a, b, **kw)

    def skew(self, c: str) -> float:
        return stats.skew(self.df, c)

    def kurtosis(self, c: str) -> float:
        return stats.kurtosis(self.df, c)

    def quantile(self, c: str, q: float) -> float:
        return stats.quantile(self.df, c, q)

    def mode(self, c: str):
        return stats.mode(self.df, c, windows.needs_order(self.order_by))

    def nunique(self, c: str) -> int:
        return stats.nunique(self.df, c)

    # windows
    def _rolling(self, c, size, function, kw) -> Frame:
        return self._new(windows.rolling(self.df, c, size, function, self.order_by, **kw))

    def rolling_mean(self, c: str, size: int, **kw) -> Frame:
        return self._rolling(c, size, "mean", kw)

    def rolling_sum(self, c: str, size: int, **kw) -> Frame:
        return self._rolling(c, size, "sum", kw)

    def rolling_std(self, c: str, size: int, **kw) -> Frame:
        return self._rolling(c, size, "std", kw)

    def expanding_mean(self, c: str, **kw) -> Frame:
        return self._new(windows.expanding(self.df, c, "mean", self.order_by, **kw))

    def expanding_sum(self, c: str, **kw) -> Frame:
        return self._new(windows.expanding(self.df, c, "sum", self.order_by, **kw))

    def rank(self, c: str, method: str = "average") -> Frame:
        return self._new(windows.rank(self.df, c, method, self.order_by))

    def pct_change(self, c: str) -> Frame:
        return self._new(windows.pct_change(self.df, c, self.order_by))

    # strings
    def str_upper(self, c: str) -> Frame:
        return self._new(texts.string_column(self.df, c, "upper"))

    def str_lower(self, c: str) -> Frame:
        return self._new(texts.string_column(self.df, c, "lower"))

    def str_strip(self, c: str) -> Frame:
        return self._new(texts.string_column(self.df, c, "strip"))

    def str_replace(self, c: str, old: str, new: str) -> Frame:
        return self._new(texts.string_column(self.df, c, "replace", old, new))

    def str_split(self, c: str, delimiter: str, as_array: bool = False) -> Frame:
        return self._new(texts.string_column(self.df, c, "split", delimiter, as_array))

    def str_contains(self, c: str, needle: str) -> Frame:
        return self._new(texts.string_column(self.df, c, "contains", needle))

    def str_len(self, c: str, unit: str = "bytes") -> Frame:
        return self._new(texts.string_column(self.df, c, "len", unit))

    def str_cat(self, c: str, separator: str = "") -> Frame:
        return self._new(texts.str_cat(self.df, c, separator, self.order_by))

    # dates
    def to_timestamps(self, c: str, **kw) -> Frame:
        return self._new(texts.to_timestamps(self.df, c, **kw))

    def dt_diff(self, c: str, **kw) -> Frame:
        return self._new(texts.dt_diff(self.df, c, self.order_by, **kw))

    def dt_shift(self, c: str, seconds: int = 0, **kw) -> Frame:
        return self._new(texts.dt_shift(self.df, c, seconds, **kw))

    # validity
    def validate_not_null(self, c: str) -> Frame:
        return self._new(texts.validate_not_null(self.df, c))

    def validate_range(self, c: str, low=None, high=None) -> Frame:
        return self._new(texts.validate_range(self.df, c, low, high))

    def validate_pattern(self, c: str, pattern: str, **kw) -> Frame:
        return self._new(texts.validate_pattern(self.df, c, pattern, **kw))

    def validate_unique(self, c: str) -> Frame:
        return self._new(windows.is_first(self.df, c, self.order_by))

    def validation_summary(self, c: str) -> dict[str, float]:
        return texts.validation_summary(self.df, c)


def _dates() -> None:
    for part in texts.datetimes.PARTS:
        setattr(Frame, f"dt_{part}", lambda self, c, part=part, **kw: self._new(texts.dt_part(self.df, c, part, **kw)))


_dates()


class GroupBy:
    """Groups of a frame; aggregates may name another frame with the same columns."""

    def __init__(self, frame: Frame, keys, strict: bool = False):
        self.frame, self.strict = frame, strict
        self.keys = grouping.checked_keys(frame.visible(), keys, strict)

    def agg(self, aggregates: list[tuple], frame: Frame | None = None) -> Frame:
        own = self.frame if frame is None else frame
        return Frame(grouping.group_by(own.df, self.keys, aggregates, own.order_by, self.strict))

    def count(self, frame: Frame | None = None) -> Frame:
        return self.agg([("count",)], frame)

    def size(self, frame: Frame | None = None) -> Frame:
        return self.agg([("size",)], frame)

    @property
    def groups(self) -> dict[tuple, list[int]]:
        """Places of each group's rows, on the driver: of DRIVER_ROWS rows at most."""
        bounded(self.frame.df, "groups", "use agg")
        out: dict[tuple, list[int]] = {}
        for i, row in enumerate(self.frame):
            out.setdefault(tuple(row[k] for k in self.keys), []).append(i)
        return out


def _aggregates() -> None:
    def method(function):
        def one(self, *args):
            frame, name = args if len(args) == 2 else (None, args[0])
            return self.agg([(function, name)], frame)

        return one

    for function in (*grouping.NUMERIC_AGGREGATES, "first", "last"):
        setattr(GroupBy, function, method(function))


_aggregates()
