import math

import pytest
from pyspark.sql import functions as F

from marlspike.frame import Frame
from marlspike.operators import filters, joins, windows
from marlspike.plans import order
from marlspike.plans.order import indexed


@pytest.fixture(scope="module")
def people(spark):
    return Frame.from_dicts(
        [
            {"name": "Ann", "age": 30, "score": 85.5, "city": "Rome"},
            {"name": "Bob", "age": None, "score": 92.0, "city": "Oslo"},
            {"name": "Cleo", "age": 35, "score": None, "city": None},
            {"name": "Dan", "age": 25, "score": 71.0, "city": "Rome"},
        ],
        spark,
    )


def test_kinds_and_round_trip(spark):
    rows = [{"a": 1, "b": 1, "c": None, "d": [1], "e": True}, {"a": 2, "b": "x", "c": None, "d": {"k": 2}, "e": None}]
    frame = Frame.from_dicts(rows, spark)
    assert frame.dtypes == {"a": "Int", "b": "Mixed", "c": "OptMixed", "d": "PyObject", "e": "OptBool"}
    assert frame.to_dicts() == rows
    assert [c for c in frame.col("b")] == [1, "x"]
    assert frame.shape == (2, 5)


def test_empty_records(spark):
    with pytest.raises(ValueError, match="Input list is empty"):
        Frame.from_dicts([], spark)


def test_later_keys(spark):
    assert Frame.from_dicts([{"a": 1}, {"b": 2}], spark).to_dicts() == [{"a": 1}, {"a": None}]


def test_filter_keeps_scanning_after_nulls(people):
    assert [r["name"] for r in people.filter("age", ">", 26)] == ["Ann", "Cleo"]
    assert [r["name"] for r in people.filter("city", "in", ["Rome"])] == ["Ann", "Dan"]
    assert [r["name"] for r in people.filter("city", "not_in", ["Rome"])] == ["Bob"]
    with pytest.raises(ValueError, match="Unknown condition: ~"):
        people.filter("age", "~", 1)
    with pytest.raises(KeyError, match="Column 'zip' not found"):
        people.filter("zip", "==", 1)


def test_sort_places_nulls(people):
    assert [r["age"] for r in people.sort_values("age")] == [25, 30, 35, None]
    assert [r["age"] for r in people.sort_values("age", ascending=False)] == [None, 35, 30, 25]


def test_in_place(people):
    own = people.copy()
    assert own.fillna({"age": 0}) is None
    own.rename_column("age", "years")
    own.cast_column("years", str)
    own.edit_column("score", lambda v: None if v is None else v * 2, "double")
    own.drop_columns(["city"])
    assert own.to_dicts()[1] == {"name": "Bob", "years": "0", "score": 184.0}
    with pytest.raises(TypeError):
        people.copy().fillna({"age": "x"})
    with pytest.raises(ValueError, match="already exists"):
        own.rename_column("name", "years")
    with pytest.raises(KeyError):
        own.drop_columns(["nothing"])


def test_edit_without_type(people):
    own = people.copy()
    own.edit_column("name", len)
    assert own.dtypes["name"] == "Int"


def test_group_by(spark):
    frame = Frame.from_dicts([{"k": k, "v": v} for k, v in [("a", 10), ("a", 20), ("b", None), ("a", 30), (None, 5)]], spark)
    groups = frame.groupby("k")
    got = {r["k"]: r for r in groups.agg([("count",), ("sum", "v"), ("mean", "v"), ("std", "v"), ("median", "v"), ("first", "v"), ("last", "v")])}
    assert got["a"] == {"k": "a", "count": 3, "v_sum": 60.0, "v_mean": 20.0, "v_std": pytest.approx(8.1649658), "v_median": 20.0, "v_first": 10, "v_last": 30}
    assert got["b"]["v_sum"] == 0.0 and got["b"]["v_mean"] is None
    assert got[None]["count"] == 1
    assert groups.groups == {("a",): [0, 1, 3], ("b",): [2], (None,): [4]}
    assert {r["k"]: r["v_max"] for r in groups.max("v")} == {"a": 30.0, "b": None, None: 5.0}
    assert {r["k"]: r["size"] for r in groups.size(frame)}["a"] == 3
    with pytest.raises(KeyError, match="Key column 'x' not found"):
        frame.groupby("x")
    with pytest.raises(TypeError, match="Only string columns"):
        frame.groupby("v", strict=True)


def test_joins(spark):
    left = Frame.from_dicts([{"id": 1, "n": "a"}, {"id": 1, "n": "b"}, {"id": 2, "n": "c"}, {"id": None, "n": "d"}], spark)
    right = Frame.from_dicts([{"id": 1, "n": "x"}, {"id": 1, "n": "y"}, {"id": 3, "n": "z"}, {"id": None, "n": "w"}], spark)
    assert left.inner_join(right, "id", "id").len() == 4
    assert left.inner_join(right, "id", "id", null_safe=True).len() == 5
    assert left.left_join(right, "id", "id").columns == ["id", "n", "n_right"]
    outer = left.outer_join(right, "id", "id").to_dicts()
    assert len(outer) == 8 and {r["id"] for r in outer} == {1, 2, 3, None}
    assert left.right_join(right, "id", "id").len() == 6
    assert left.cross_join(right).len() == 16
    with pytest.raises(KeyError, match="Left column 'q' not found"):
        left.inner_join(right, "q", "id")
    with pytest.raises(ValueError, match="Right column 'q' not found"):
        left.inner_join(right, "id", "q")
    with pytest.raises(ValueError, match="Number of join columns must match"):
        left.inner_join(right, ["id", "n"], ["id"])


def test_statistics(spark):
    frame = Frame.from_dicts([{"x": float(v), "y": 2.0 * v, "c": 1.0, "m": m} for v, m in [(1, "a"), (2, "b"), (3, "b"), (4, "a"), (10, "c")]], spark)
    assert frame.corr_with("x", "y") == pytest.approx(1.0)
    assert frame.corr_with("x", "c") == 0.0
    assert frame.quantile("x", 0.5) == 3.0
    assert frame.mode("m") == "b"
    assert frame.nunique("m") == 3
    assert frame.skew("c") == 0.0 and frame.kurtosis("c") == 0.0
    described = {r["statistic"]: r["x"] for r in frame.describe()}
    assert (described["25%"], described["50%"], described["75%"]) == (2.0, 3.0, 4.0)
    with pytest.raises(ValueError, match="Quantile must be between"):
        frame.quantile("x", 2)
    with pytest.raises(TypeError, match="numeric"):
        frame.skew("m")


def test_windows(spark):
    frame = Frame.from_dicts([{"v": v} for v in [1.0, None, 3.0, 4.0]], spark)
    assert [r["v_rolling_mean"] for r in frame.rolling_mean("v", 2)] == [None, None, None, 3.5]
    assert [r["v_rolling_mean"] for r in frame.rolling_mean("v", 2, min_periods=1)] == [1.0, 1.0, 3.0, 3.5]
    assert [r["v_expanding_sum"] for r in frame.expanding_sum("v")] == [1.0, 1.0, 4.0, 8.0]
    assert [r["v_pct_change"] for r in frame.pct_change("v")] == [None, None, None, pytest.approx(100 / 3)]
    ties = Frame.from_dicts([{"v": v} for v in [3.0, 1.0, 3.0, 2.0, None]], spark)
    assert [r["v_rank"] for r in ties.rank("v")] == [3.5, 1.0, 3.5, 2.0, None]
    assert [r["v_rank"] for r in ties.rank("v", "first")] == [3.0, 1.0, 4.0, 2.0, None]
    with pytest.raises(ValueError, match="Invalid ranking method"):
        ties.rank("v", "best")
    with pytest.raises(ValueError):
        frame.rolling_mean("v", 0)


def test_order_survives_partitioning(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 13 as double) as v")
    plain = windows.rolling(df, "v", 4, "sum", "id").orderBy("id").collect()
    for n in (1, 7):
        assert windows.rolling(df.repartition(n), "v", 4, "sum", "id", small_bytes=0).orderBy("id").collect() == plain
    got = indexed(df.repartition(5), ["id"], "index_", 6).collect()
    assert all(r["index_"] == r["id"] for r in got)


def test_scalable_window_has_no_single_partition(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as double) as v")
    plan = windows.rolling(df, "v", 4, "sum", "id", small_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not [x for x in plan.split("\n") if "Exchange SinglePartition" in x and "Window" in x]


def test_strings_and_dates(spark):
    frame = Frame.from_dicts([{"t": " aé\t", "d": "2024-02-29"}, {"t": None, "d": "2023-02-29 00:00:00"}, {"t": "x,y", "d": "2024-01-01T01:02:03.5Z"}], spark)
    assert [r["t_strip"] for r in frame.str_strip("t")] == ["aé", None, "x,y"]
    assert [r["t_len"] for r in frame.str_len("t")] == [5, None, 3]
    assert [r["t_split"] for r in frame.str_split("t", ",")][2] == "x|y"
    assert [r["t_cat"] for r in frame.str_cat("t", "+")] == [" aé\t+x,y"] * 3
    assert [r["d_year"] for r in frame.dt_year("d")] == [2024, 0, 2024]
    assert [r["d_timestamp"] for r in frame.to_timestamps("d", date_only="zero")] == [0, 0, 1704070923]
    assert [r["d_timestamp"] for r in frame.to_timestamps("d", errors="null")][1] is None
    with pytest.raises(TypeError, match="string columns"):
        Frame.from_dicts([{"n": 1}], spark).str_upper("n")


def test_validity(spark):
    frame = Frame.from_dicts([{"n": 1.0, "t": "a"}, {"n": float("nan"), "t": "a"}, {"n": None, "t": None}], spark)
    assert [r["n_in_range"] for r in frame.validate_range("n", 1, 2)] == [True, False, True]
    assert [r["t_unique"] for r in frame.validate_unique("t")] == [True, False, True]
    assert [r["t_matches_pattern"] for r in frame.validate_pattern("t", "b")] == [False, False, True]
    assert frame.validation_summary("n") == {"null_count": 1.0, "null_percentage": pytest.approx(100 / 3), "total_count": 3.0, "non_null_count": 2.0}
    assert math.isnan(frame.filter("t", "==", "z").validation_summary("n")["null_percentage"])


def test_filters_reach_the_scan(spark, small):
    df = filters.filter_rows(spark.read.parquet(f"{small}/lineitem.parquet"), "l_quantity", ">", 30.0).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "l_comment" not in plan


def test_semi_join(spark):
    a, b = spark.range(5), spark.range(3)
    assert joins.join(a, b, "id", "id", "semi").count() == 3
    assert joins.join(a, b, "id", "id", "anti").count() == 2


def test_float_text(spark):
    from pyspark.sql import functions as F

    from marlspike.functions.casts import float_to_int, float_to_str

    values = [1.0, 0.5, 1e21, 1.5e-7, -2.25e10, float("nan"), 1234567.875, 12345678.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(float_to_str(F.col("v"))).collect()]
    assert got == ["1", "0.5", "1000000000000000000000", "0.00000015", "-22500000000", "NaN", "1234567.875", "12345678.5"]
    assert [r[0] for r in df.select(float_to_int(F.col("v"))).collect()][2:6] == [2**63 - 1, 0, -22500000000, 0]


def test_order_of_a_sorted_frame_survives_changes(spark):
    frame = Frame.from_dicts([{"a": i % 3, "b": i, "c": str(i)} for i in range(12)], spark).sort_values(["a", "b"], [False, True])
    frame.drop_columns("b")
    frame.rename_column("a", "z")
    assert [r["c"] for r in frame] == [str(i) for a in (2, 1, 0) for i in range(12) if i % 3 == a]
    assert frame.sort_values("z").filter("z", "==", 1).head(2) == [{"z": 1, "c": "1"}, {"z": 1, "c": "4"}]


def test_tail_counts_nulls_and_sets(spark):
    frame = Frame.from_dicts([{"k": "x", "n": 1}, {"k": None, "n": 2}, {"k": "y", "n": None}, {"k": "x", "n": 1}], spark)
    assert frame.tail(2) == [{"k": "y", "n": None}, {"k": "x", "n": 1}]
    assert frame.value_counts("k").to_dicts() == [{"k": "x", "count": 2}, {"k": "y", "count": 1}]
    assert [r["k"] for r in frame.isnull()] == [False, True, False, False]
    assert frame.concat(frame).len() == 8 and frame.distinct().len() == 3
    assert frame.intersect(frame.filter("n", "==", 1)).len() == 1 and frame.except_rows(frame.filter("n", "==", 1)).len() == 2
    assert frame.operation_count() > 0 and frame.memory_usage() > 0


def test_dictionary_round_trip(spark):
    frame = Frame.from_dicts([{"k": v, "i": i} for i, v in enumerate(["b", "a", None, "b", "é"])], spark)
    codes = frame.dictionary("k")
    assert codes.to_dicts() == [{"value": "a", "id": 0}, {"value": "b", "id": 1}, {"value": "é", "id": 2}]
    coded = frame.encode("k", codes)
    assert [r["k_id"] for r in coded] == [1, 0, None, 1, 2]
    assert coded.decode("k", codes).to_dicts() == frame.to_dicts()


def test_first_occurrences_of_frequent_values_and_nulls(spark):
    from marlspike.operators import windows

    df = spark.createDataFrame([(i, None if i % 5 == 0 else "x" if i % 3 else f"v{i}") for i in range(300)], "i long, v string")
    small, salted = ({r["i"]: r["v_unique"] for r in windows.is_first(df, "v", "i", b).collect()} for b in (windows.SMALL_BYTES, 0))
    assert small == salted and small[1] and not small[2] and small[0]


def test_places_are_the_same_with_ties_and_many_buckets(spark):
    from pyspark.sql import functions as F

    from marlspike.plans import order

    df = spark.range(5000).select(F.col("id"), (F.xxhash64("id") % 40).alias("k"))
    placed = [{r["id"]: r["at"] for r in order.indexed(df.repartition(n), ["k"], "at", buckets).collect()} for n, buckets in ((3, 1), (5, 7), (2, 100))]
    assert placed[0] == placed[1] == placed[2] and sorted(placed[0].values()) == list(range(5000))


def test_driver_rows_are_bounded(spark, monkeypatch):
    from marlspike import frame as m

    own = Frame.from_dicts([{"k": "x", "n": i} for i in range(5)], spark)
    monkeypatch.setattr(m, "DRIVER_ROWS", 5)
    assert own.groupby("k").groups == {("x",): [0, 1, 2, 3, 4]}
    monkeypatch.setattr(m, "DRIVER_ROWS", 4)
    with pytest.raises(ValueError, match="more than 4"):
        own.groupby("k").groups
    with pytest.raises(ValueError, match="pass returns"):
        own.edit_column("n", lambda v: v + 1)
    own.edit_column("n", lambda v: v + 1, "bigint")
    assert [r["n"] for r in own] == [1, 2, 3, 4, 5]


def test_lazy_dicts_stay_with_the_executors(spark, small, monkeypatch):
    from pyspark.sql import DataFrame

    from marlspike.plans import catalogue

    rows = [{"k": i, "mixed": [None, 1, "x", 0.5][i % 4]} for i in range(40)]
    frame = Frame.from_dicts(rows, spark).sort_values("k", False)
    assert frame.to_dicts(lazy=True).collect() == frame.to_dicts() == rows[::-1]
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)  # brings all rows to the driver
    for name, key in (("to_dicts", "o_orderkey"), ("sort_iterated", "at"), ("sort_then_change", "at")):
        out = catalogue.QUERIES[name](spark, small)
        assert out.select(key).distinct().count() == out.count() > 0


def test_windows_fall_away_where_they_are_not_needed(spark):
    df = spark.range(3000).select("id", (F.col("id") % 70).cast("double").alias("v"))
    made = windows.expanding(windows.rolling(df, "v", 3, "sum", "id", small_bytes=0), "v", "sum", "id", small_bytes=0)
    plan = made.select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Union" not in plan


def test_windows_are_cut_by_rows_not_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(order, "BLOCK_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.range(3000).select("id", F.lit(1.0).alias("v")).write.parquet(f"{tmp_path}/t")
        df = spark.read.parquet(f"{tmp_path}/t")  # a few bytes a row and less
        for out in (windows.expanding(df, "v", "sum", "id", small_bytes=0), windows.pct_change(df, "v", "id", small_bytes=0), order.indexed(df, ["id"], "at")):
            made = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.count(out.columns[-1]))
            most = max(r["count"] for r in made.collect())
            assert most < 1500 and out.count() == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    key = F.when(F.col("id") % 5 != 0, F.struct(F.col("id").cast("string").alias("a"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("b")))
    held = order.indexed(df.withColumn("k", key), ["k", "id"], "at").orderBy("at").collect()
    assert [r["at"] for r in held] == list(range(3000)) and [r["id"] for r in held] == [*range(0, 3000, 5), *sorted((i for i in range(3000) if i % 5), key=str)]


def test_places_of_groups_are_exact(spark, monkeypatch):
    from marlspike.operators import grouping
    from marlspike.plans import places

    id_, groups = F.col("id"), F.col("id") % 5
    when = F.timestamp_seconds(1698540000 + groups * 3600)
    df = spark.range(4001).select(F.when(groups > 0, when).alias("t"), F.when(groups == 1, F.lit(float("nan"))).otherwise(groups / 2).alias("f"), F.encode(groups.cast("string"), "utf-8").alias("b"), F.when(id_ % 7 > 0, F.pow(-1.5, id_ % 300)).alias("x"))
    median = lambda small: sorted(map(str, grouping.group_by(df, ["t", "f", "b"], [("median", "x"), ("count",)], small_bytes=small).collect()))
    expected = median(1 << 40)
    assert len(expected) == 5 and median(0) == expected
    monkeypatch.setattr(places, "WIDTHS", (0.0, 1.0))
    monkeypatch.setattr(places, "ACCURACY", 3)  # bounds miss their places
    assert median(0) == expected
    monkeypatch.setattr(places, "MOST_GROUPS", 4)
    assert median(0) == expected


def test_many_rows_of_few_bytes_are_not_one_task(spark, monkeypatch, tmp_path):
    from marlspike.operators import stats

    spark.range(1_200_000).select((F.col("id") % 9).alias("v")).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(stats, "at_place", None)  # exact percentiles of all values in one task
    got = {r["statistic"]: r["v"] for r in stats.describe(spark.read.parquet(f"{tmp_path}/t")).collect()}
    assert (got["25%"], got["50%"], got["75%"]) == (2.0, 4.0, 6.0)
