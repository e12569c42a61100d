"""The registered queries of the library and the SQL that they are checked against.

Floating sums are rounded on both sides, since their order differs. Nulls, which the tables do not have,
are made with nullif.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions import casts, datetimes
from ..operators import columns, dictionary, filters, grouping, joins, stats, texts, windows
from ..sources.records import from_dicts
from ..sources.tables import table
from ..streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Revenue statistics of discounted line items by part brand, ranked by revenue: a filter, a join, a grouping and a rank."""
    items = filters.filter_rows(table(spark, d, "lineitem"), "l_discount", ">=", 0.05)
    joined = joins.inner_join(items, table(spark, d, "part"), "l_partkey", "p_partkey")
    out = rounded(grouping.group_by(joined, "p_brand", [("sum", "l_extendedprice"), ("mean", "l_quantity"), ("count",)]), "l_extendedprice_sum", "l_quantity_mean")
    return windows.rank(out, "l_extendedprice_sum", "min")


register("flagship", flagship, """SELECT *, CAST(rank() OVER (ORDER BY l_extendedprice_sum) AS DOUBLE) AS l_extendedprice_sum_rank FROM (
SELECT p_brand, round(sum(l_extendedprice), 4) AS l_extendedprice_sum, round(avg(l_quantity), 4) AS l_quantity_mean, count(*) AS count
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.05 GROUP BY 1)""")

# filters
for _name, _op, _value, _sql in [
    ("eq", "==", "F", "o_orderstatus = 'F'"),
    ("ne", "!=", "F", "o_orderstatus <> 'F'"),
    ("gt", ">", 150000.0, "o_totalprice > 150000"),
    ("lt", "<", 50000.0, "o_totalprice < 50000"),
    ("ge", ">=", 150000.0, "o_totalprice >= 150000"),
    ("le", "<=", 50000.0, "o_totalprice <= 50000"),
    ("in", "in", ["1-URGENT", "2-HIGH"], "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("not_in", "not_in", ["1-URGENT", "2-HIGH"], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
]:
    _column = _sql.split()[0]
    register(f"filter_{_name}", lambda s, d, c=_column, o=_op, v=_value: filters.filter_rows(table(s, d, "orders"), c, o, v).select("o_orderkey", c), f"SELECT o_orderkey, {_column} FROM orders WHERE {_sql}")


def prioritised(s, d) -> DataFrame:
    return table(s, d, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).select("o_orderkey", "o_totalprice", "p")


PRIORITISED = "(SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS p FROM orders)"
register("filter_null_excluded", lambda s, d: filters.filter_rows(prioritised(s, d), "p", "!=", "1-URGENT"), f"SELECT * FROM {PRIORITISED} WHERE p <> '1-URGENT'")
register("filter_chain", lambda s, d: filters.filter_rows(filters.filter_rows(table(s, d, "lineitem"), "l_quantity", ">", 30.0), "l_returnflag", "==", "R").select("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
register("dropna", lambda s, d: columns.dropna(prioritised(s, d), "p"), f"SELECT * FROM {PRIORITISED} WHERE p IS NOT NULL")
register("fillna", lambda s, d: columns.fillna(prioritised(s, d), {"p": "none"}), f"SELECT o_orderkey, o_totalprice, coalesce(p, 'none') AS p FROM {PRIORITISED}")
register("stringify", lambda s, d: prioritised(s, d).select("o_orderkey", columns.stringify(F.col("p")).alias("p")), f"SELECT o_orderkey, coalesce(p, 'None') AS p FROM {PRIORITISED}")

# projection and casts
register("rename_drop_select", lambda s, d: columns.select(columns.rename_column(columns.drop_columns(table(s, d, "nation"), ["n_regionkey"]), "n_name", "name"), "n_nationkey", "name"), "SELECT n_nationkey, n_name AS name FROM nation")


def cast_matrix(s, d) -> DataFrame:
    df = table(s, d, "part").withColumn("t", F.when(F.col("p_size") % 3 == 0, F.lit("x")).otherwise(F.col("p_size").cast("string")))
    size, price, c = F.col("p_size").cast("bigint"), F.col("p_retailprice"), casts.cast
    made = {"int_str": c(size, "Int", "Str", True), "int_float": c(size, "Int", "Float", True), "int_bool": c(size, "Int", "Bool", True), "float_int": c(price, "Float", "Int", True), "float_bool": c(price, "Float", "Bool", True), "str_int": c(F.col("t"), "Str", "Int", True), "str_float": c(F.col("t"), "Str", "Float", True), "str_bool": c(F.col("t"), "Str", "Bool", True), "str_int_zero": c(F.col("t"), "Str", "Int", False), "bool_int": c(size > 10, "Bool", "Int", True), "bool_str": c(size > 10, "Bool", "Str", True)}
    return df.select("p_partkey", *[v.alias(k) for k, v in made.items()])


register("cast_matrix", cast_matrix, """SELECT p_partkey, CAST(p_size AS VARCHAR) AS int_str, CAST(p_size AS DOUBLE) AS int_float, p_size <> 0 AS int_bool, CAST(trunc(p_retailprice) AS BIGINT) AS float_int, p_retailprice <> 0 AS float_bool,
TRY_CAST(t AS BIGINT) AS str_int, TRY_CAST(t AS DOUBLE) AS str_float, length(t) > 0 AS str_bool, coalesce(TRY_CAST(t AS BIGINT), 0) AS str_int_zero, CAST(p_size > 10 AS BIGINT) AS bool_int, CAST(p_size > 10 AS VARCHAR) AS bool_str
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)""")
register("cast_float_str", lambda s, d: table(s, d, "part").select("p_partkey", casts.float_to_str(F.col("p_size") * 0.5).alias("t")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS t FROM part")
register("edit_column", lambda s, d: columns.edit_column(table(s, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size")), "p_size", lambda v: None if v is None else v * 2 + 1, "bigint"), "SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS p_size FROM part")
register("edit_column_vectorised", lambda s, d: columns.edit_column_vectorised(table(s, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size")), "p_size", lambda v: v * 2 + 1, "bigint"), "SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS p_size FROM part")
register("from_dicts", lambda s, d: from_dicts(s, [{"name": "a", "n": 1}, {"name": None, "n": 2}, {"n": 3}]).drop("__ord"), "SELECT * FROM (VALUES ('a', CAST(1 AS BIGINT)), (NULL, 2), (NULL, 3)) t(name, n)")

# sorting
def sorted_part(s, d) -> Frame:
    """A frame with nulls and ties, sorted by two columns, one of them descending; the order before keeps ties."""
    return Frame(table(s, d, "part").select("p_partkey", "p_brand", F.nullif(F.col("p_size"), F.lit(7)).alias("size")), "p_partkey").sort_values(["size", "p_brand"], [False, True])


def placed(frame: Frame) -> DataFrame:
    """The rows and their places in the frame's order, as its own records follow each other."""
    rows = frame.to_dicts(lazy=True).zipWithIndex().map(lambda r: r[0] | {"at": r[1]})
    return frame.df.sparkSession.createDataFrame(rows, frame.visible().withColumn("at", F.lit(0).cast("bigint")).schema)


SORTED = "SELECT *, row_number() OVER (ORDER BY size DESC NULLS FIRST, p_brand, p_partkey) - 1 AS at FROM (SELECT p_partkey, p_brand, nullif(p_size, 7) AS size FROM part)"
# the places by the frame's order column, and as its records follow each other
register("sort_multi", lambda s, d: (f := sorted_part(s, d)).df.select(*f.columns, (F.row_number().over(Window.orderBy(*f.order_by)) - 1).cast("bigint").alias("at")), SORTED)
register("sort_iterated", lambda s, d: placed(sorted_part(s, d)), SORTED)
register("sort_then_change", lambda s, d: placed(renamed(sorted_part(s, d))), SORTED.replace("SELECT *,", "SELECT p_partkey, size AS width,"))


def renamed(frame: Frame) -> Frame:
    """Columns that a frame was sorted by can be dropped and renamed: the order stays."""
    frame.drop_columns("p_brand")
    frame.rename_column("size", "width")
    return frame


register("top_k", lambda s, d: filters.top_k(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 50, False), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
register("union", lambda s, d: filters.union(table(s, d, "nation").select("n_name"), table(s, d, "region").select(F.col("r_name").alias("n_name"))), "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")

register("intersect", lambda s, d: filters.intersect(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
register("except", lambda s, d: filters.except_rows(table(s, d, "nation").select(F.col("n_nationkey").alias("k")), table(s, d, "region").select(F.col("r_regionkey").alias("k"))), "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
register("distinct", lambda s, d: filters.distinct(table(s, d, "lineitem").select("l_returnflag", "l_linestatus")), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
register("isnull", lambda s, d: columns.isnull(prioritised(s, d)).groupBy("o_orderkey", "o_totalprice", "p").count(), f"SELECT o_orderkey IS NULL AS o_orderkey, o_totalprice IS NULL AS o_totalprice, p IS NULL AS p, count(*) AS count FROM {PRIORITISED} GROUP BY 1, 2, 3")
register("cast_column", lambda s, d: columns.cast_column(columns.cast_column(table(s, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", int), "p_size", str), "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice, CAST(p_size AS VARCHAR) AS p_size FROM part")
register("to_dicts", lambda s, d: s.createDataFrame(Frame(prioritised(s, d), "o_orderkey").to_dicts(lazy=True), prioritised(s, d).schema), f"SELECT * FROM {PRIORITISED}")
register("head_tail", lambda s, d: s.createDataFrame([*ordered_orders(s, d).head(7), *ordered_orders(s, d).tail(5)], prioritised(s, d).schema), f"(SELECT * FROM {PRIORITISED} ORDER BY o_orderkey LIMIT 7) UNION ALL (SELECT * FROM {PRIORITISED} ORDER BY o_orderkey DESC LIMIT 5)")
register("chunks", lambda s, d: events.process_in_chunks(table(s, d, "orders").select("o_orderkey", "o_totalprice"), doubled, "o_orderkey bigint, twice double"), "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")


def ordered_orders(s, d) -> Frame:
    return Frame(prioritised(s, d), "o_orderkey")


def doubled(frames):
    for frame in frames:
        yield frame.assign(twice=frame["o_totalprice"] * 2)[["o_orderkey", "twice"]]


# joins
def sides(s, d) -> tuple[DataFrame, DataFrame]:
    """Whole tables; keys of suppliers are moved on so that both sides have rows without a partner."""
    return table(s, d, "nation"), table(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 10).alias("s_nationkey"))


LEFT, RIGHT = "nation l", "(SELECT s_suppkey, s_nationkey + 10 AS s_nationkey FROM supplier) r"
for _how, _columns, _kind in [
    ("inner", "n_nationkey, n_name, n_regionkey, s_suppkey", "JOIN"),
    ("left", "n_nationkey, n_name, n_regionkey, s_suppkey", "LEFT JOIN"),
    ("right", "n_name, n_regionkey, s_suppkey, s_nationkey", "RIGHT JOIN"),
    ("outer", "n_nationkey, n_name, n_regionkey, s_suppkey, s_nationkey", "FULL JOIN"),
]:
    register(f"join_{_how}", lambda s, d, how=_how: joins.join(*sides(s, d), "n_nationkey", "s_nationkey", how), f"SELECT {_columns} FROM {LEFT} {_kind} {RIGHT} ON n_nationkey = s_nationkey")
register("join_semi", lambda s, d: joins.join(*sides(s, d), "n_nationkey", "s_nationkey", "semi"), f"SELECT * FROM {LEFT} WHERE n_nationkey IN (SELECT s_nationkey FROM {RIGHT})")
register("join_anti", lambda s, d: joins.join(*sides(s, d), "n_nationkey", "s_nationkey", "anti"), f"SELECT * FROM {LEFT} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {RIGHT})")
register("join_orders", lambda s, d: joins.inner_join(table(s, d, "orders"), table(s, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "c_mktsegment"), "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")


def flags(s, d, function: str) -> DataFrame:
    return grouping.group_by(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [(function, "l_quantity")])


register("join_multi_key", lambda s, d: joins.inner_join(flags(s, d, "min"), flags(s, d, "max"), ["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY 1, 2")
register("join_same_key_outer", lambda s, d: joins.outer_join(table(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), table(s, d, "region").select((F.col("r_regionkey") + 23).alias("k"), F.col("r_name").alias("n_name")), "k", "k"), "SELECT coalesce(n_nationkey, k) AS k, n_name, r_name AS n_name_right FROM nation FULL JOIN (SELECT r_regionkey + 23 AS k, r_name FROM region) ON n_nationkey = k")
register("join_cross", lambda s, d: joins.cross_join(table(s, d, "region"), table(s, d, "nation").select("n_name")), "SELECT region.*, n_name FROM region CROSS JOIN nation")


def null_keys(s, d, name: str) -> DataFrame:
    return table(s, d, "nation").select(F.nullif(F.col("n_nationkey") % 5, F.lit(0)).alias("k"), F.col("n_name").alias(name))


register("join_null_safe", lambda s, d: joins.inner_join(null_keys(s, d, "a"), null_keys(s, d, "b"), "k", "k", null_safe=True), "SELECT l.k AS k, a, b FROM (SELECT nullif(n_nationkey % 5, 0) AS k, n_name AS a FROM nation) l JOIN (SELECT nullif(n_nationkey % 5, 0) AS k, n_name AS b FROM nation) r ON l.k IS NOT DISTINCT FROM r.k")
register("join_null_keys", lambda s, d: joins.inner_join(null_keys(s, d, "a"), null_keys(s, d, "b"), "k", "k"), "SELECT l.k AS k, a, b FROM (SELECT nullif(n_nationkey % 5, 0) AS k, n_name AS a FROM nation) l JOIN (SELECT nullif(n_nationkey % 5, 0) AS k, n_name AS b FROM nation) r ON l.k = r.k")

# grouping
for _f, _sql in [("sum", "sum(l_extendedprice)"), ("mean", "avg(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("std", "stddev_pop(l_extendedprice)"), ("var", "var_pop(l_extendedprice)"), ("median", "median(l_extendedprice)")]:
    _digits = 2 if _f in ("sum", "var") else 4
    register(f"gb_{_f}", lambda s, d, f=_f, n=_digits: rounded(grouping.group_by(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [(f, "l_extendedprice")]), f"l_extendedprice_{f}", digits=n), f"SELECT l_returnflag, l_linestatus, round({_sql}, {_digits}) AS l_extendedprice_{_f} FROM lineitem GROUP BY 1, 2")
register("gb_median_places", lambda s, d: rounded(grouping.group_by(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [("median", "l_extendedprice"), ("count",)], small_bytes=0), "l_extendedprice_median"), "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS l_extendedprice_median, count(*) AS count FROM lineitem GROUP BY 1, 2")
register("gb_median_null_key_places", lambda s, d: rounded(grouping.group_by(prioritised(s, d), "p", [("median", "o_totalprice")], small_bytes=0), "o_totalprice_median"), f"SELECT p, round(median(o_totalprice), 4) AS o_totalprice_median FROM {PRIORITISED} GROUP BY 1")
for _f in ("count", "size"):
    register(f"gb_{_f}", lambda s, d, f=_f: grouping.group_by(table(s, d, "lineitem"), "l_returnflag", [(f,)]), f"SELECT l_returnflag, count(*) AS {_f} FROM lineitem GROUP BY 1")
register("gb_multi_agg", lambda s, d: rounded(grouping.group_by(table(s, d, "orders"), "o_orderpriority", [("count",), ("mean", "o_totalprice"), ("max", "o_totalprice")]), "o_totalprice_mean"), "SELECT o_orderpriority, count(*) AS count, round(avg(o_totalprice), 4) AS o_totalprice_mean, max(o_totalprice) AS o_totalprice_max FROM orders GROUP BY 1")
register("gb_null_key", lambda s, d: grouping.group_by(prioritised(s, d), "p", [("count",)]), f"SELECT p, count(*) AS count FROM {PRIORITISED} GROUP BY 1")
register("gb_sum_all_null", lambda s, d: rounded(grouping.group_by(table(s, d, "events").withColumn("v", F.when(F.col("event_type") != "click", F.col("value"))), "event_type", [("sum", "v")]), "v_sum"), "SELECT event_type, round(coalesce(sum(CASE WHEN event_type <> 'click' THEN value END), 0), 4) AS v_sum FROM events GROUP BY 1")
register("gb_first", lambda s, d: grouping.group_by(table(s, d, "events"), "event_type", [("first", "value")], ["event_id"]), "SELECT event_type, arg_min_null(value, event_id) AS value_first FROM events GROUP BY 1")
register("gb_last", lambda s, d: grouping.group_by(table(s, d, "events"), "event_type", [("last", "value")], ["event_id"]), "SELECT event_type, arg_max_null(value, event_id) AS value_last FROM events GROUP BY 1")
register("gb_not_numeric", lambda s, d: grouping.group_by(table(s, d, "events"), "event_type", [("mean", "props")]), "SELECT event_type, CAST(NULL AS DOUBLE) AS props_mean FROM events GROUP BY 1")
register("gb_sum_own_name", lambda s, d: rounded(grouping.group_sum(table(s, d, "orders"), "o_orderstatus", "o_totalprice"), "o_totalprice", digits=2), "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
register("gb_mean_all_rows", lambda s, d: rounded(grouping.group_mean(table(s, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))), "o_orderstatus", "v", True), "v"), "SELECT o_orderstatus, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / count(*), 4) AS v FROM orders GROUP BY 1")
register("gb_apply", lambda s, d: grouping.group_apply(table(s, d, "nation").select("n_regionkey", "n_nationkey"), "n_regionkey", lambda pdf: pdf.groupby("n_regionkey", as_index=False).agg(top=("n_nationkey", "max")), "n_regionkey int, top int"), "SELECT n_regionkey, max(n_nationkey) AS top FROM nation GROUP BY 1")

# statistics
register("describe", lambda s, d: rounded(stats.describe(table(s, d, "orders").select("o_totalprice")), "o_totalprice"), """WITH a AS (SELECT list_sort(list(o_totalprice)) AS v, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, median(o_totalprice) AS md FROM orders)
SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic, round(unnest([CAST(len(v) AS DOUBLE), m, sd, v[1], v[len(v) // 4 + 1], md, v[3 * len(v) // 4 + 1], v[len(v)]]), 4) AS o_totalprice FROM a""")
register("describe_places", lambda s, d: rounded(stats.describe(table(s, d, "orders").select("o_totalprice"), small_bytes=0), "o_totalprice"), SQL["describe"])
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
for _m, _f in (("corr", "corr"), ("cov", "covar_pop")):
    register(f"{_m}_matrix", lambda s, d, m=_m: rounded(getattr(stats, m)(table(s, d, "lineitem").select(*NUMBERS)), *NUMBERS, digits=3), " UNION ALL ".join(f"SELECT '{a}' AS \"column\", " + ", ".join(f"round({_f}({a}, {b}), 3) AS {b}" for b in NUMBERS) + " FROM lineitem" for a in NUMBERS))
register("corr_with", lambda s, d: table(s, d, "lineitem").agg(F.round(stats.correlation("l_quantity", "l_extendedprice"), 4).alias("r")), "SELECT round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem")
register("corr_constant", lambda s, d: table(s, d, "lineitem").withColumn("one", F.lit(1.0)).agg(stats.correlation("l_quantity", "one").alias("r")), "SELECT CAST(0 AS DOUBLE) AS r")
register("cov_with", lambda s, d: table(s, d, "lineitem").agg(F.round(stats.covariance("l_quantity", "l_extendedprice"), 3).alias("r")), "SELECT round(covar_pop(l_quantity, l_extendedprice), 3) AS r FROM lineitem")
register("skew", lambda s, d: table(s, d, "lineitem").agg(F.round(stats.skewness("l_extendedprice"), 5).alias("r")), "SELECT round(avg(power(l_extendedprice - m, 3)) / power(max(sd), 3), 5) AS r FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem)")
register("kurtosis", lambda s, d: table(s, d, "part").agg(F.round(stats.excess_kurtosis("p_retailprice"), 5).alias("r")), "SELECT round(kurtosis_pop(p_retailprice), 5) AS r FROM part")
def value(s, kind: str, name: str, v) -> DataFrame:
    """One row with a value that an operator has returned to the driver."""
    return s.createDataFrame([(v,)], f"{name} {kind}")


register("quantile", lambda s, d: value(s, "double", "q", round(stats.quantile(table(s, d, "orders"), "o_totalprice", 0.9), 4)), "SELECT round(quantile_cont(o_totalprice, 0.9), 4) AS q FROM orders")
register("quantile_places", lambda s, d: value(s, "double", "q", round(stats.quantile(table(s, d, "orders"), "o_totalprice", 0.9, small_bytes=0), 4)), SQL["quantile"])
register("mode", lambda s, d: stats.modes(table(s, d, "events"), "event_type", ["event_id"]), "SELECT event_type AS mode FROM events GROUP BY 1 ORDER BY count(*) DESC, max(event_id) LIMIT 1")
register("nunique", lambda s, d: value(s, "bigint", "n", stats.nunique(prioritised(s, d), "p")), f"SELECT count(DISTINCT p) AS n FROM {PRIORITISED}")
register("value_counts", lambda s, d: stats.value_counts(prioritised(s, d), "p"), f"SELECT p, count(*) AS count FROM {PRIORITISED} WHERE p IS NOT NULL GROUP BY 1")
register("dot_product", lambda s, d: value(s, "double", "dot", round(stats.dot_product(table(s, d, "part"), "p_retailprice", "p_size"), 2)), "SELECT round(sum(p_retailprice * p_size), 2) AS dot FROM part")
register("add_multiply", lambda s, d: table(s, d, "part").select("p_partkey", stats.add(F.col("p_size"), F.lit(3)).cast("bigint").alias("added"), stats.multiply(F.col("p_size"), F.col("p_partkey")).cast("bigint").alias("multiplied")), "SELECT p_partkey, CAST(p_size + 3 AS BIGINT) AS added, CAST(p_size * p_partkey AS BIGINT) AS multiplied FROM part")
register("kernels", lambda s, d: table(s, d, "part").agg(*[F.round(stats.KERNELS[k](F.col("p_retailprice")), 3).alias(k) for k in stats.KERNELS], F.round(F.sum(F.col("p_retailprice") * F.col("p_size")), 2).alias("dot")), "SELECT round(sum(p_retailprice), 3) AS sum, round(avg(p_retailprice), 3) AS mean, round(min(p_retailprice), 3) AS min, round(max(p_retailprice), 3) AS max, round(var_samp(p_retailprice), 3) AS variance, round(stddev_samp(p_retailprice), 3) AS std_dev, round(sum(p_retailprice * p_size), 2) AS dot FROM part")


# windows
def valued(s, d) -> DataFrame:
    return table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


VALUED = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"
for _f, _sql in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_pop")):
    register(f"rolling_{_f}", lambda s, d, f=_f: rounded(windows.rolling(valued(s, d), "v", 5, f, "event_id", 4), f"v_rolling_{f}"), f"SELECT event_id, v, CASE WHEN count(v) OVER w >= 4 THEN round({_sql}(v) OVER w, 4) END AS v_rolling_{_f} FROM {VALUED} WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
register("rolling_mean_blocks", lambda s, d: rounded(windows.rolling(valued(s, d), "v", 5, "mean", "event_id", 4, small_bytes=0), "v_rolling_mean"), SQL["rolling_mean"])
for _f, _sql in (("mean", "avg"), ("sum", "sum")):
    # the small constant keeps means off the middle between two rounded values
    register(f"expanding_{_f}", lambda s, d, f=_f: windows.expanding(valued(s, d), "v", f, "event_id").withColumn(f"v_expanding_{f}", F.round(F.col(f"v_expanding_{f}") + 1.3e-6, 5)), f"SELECT event_id, v, round({_sql}(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 1.3e-6, 5) AS v_expanding_{_f} FROM {VALUED}")
register("expanding_sum_buckets", lambda s, d: windows.expanding(valued(s, d), "v", "sum", "event_id", small_bytes=0).withColumn("v_expanding_sum", F.round(F.col("v_expanding_sum") + 1.3e-6, 5)), SQL["expanding_sum"])
for _m, _sql in [("average", "rank() OVER w + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0"), ("min", "rank() OVER w"), ("max", "rank() OVER w + count(*) OVER (PARTITION BY p_size) - 1"), ("dense", "dense_rank() OVER w"), ("first", "row_number() OVER (ORDER BY p_size, p_partkey)")]:
    _text = f"SELECT p_partkey, p_size, CAST({_sql} AS DOUBLE) AS p_size_rank FROM part WINDOW w AS (ORDER BY p_size)"
    register(f"rank_{_m}", lambda s, d, m=_m: windows.rank(table(s, d, "part").select("p_partkey", "p_size"), "p_size", m, ["p_partkey"]), _text)
    register(f"rank_{_m}_counted", lambda s, d, m=_m: windows.rank(table(s, d, "part").select("p_partkey", "p_size"), "p_size", m, ["p_partkey"], small_bytes=0), _text)
CHANGED = f"SELECT event_id, v, round(CASE WHEN lag(v) OVER (ORDER BY event_id) <> 0 THEN (v - lag(v) OVER (ORDER BY event_id)) / lag(v) OVER (ORDER BY event_id) * 100 END, 3) AS v_pct_change FROM {VALUED}"
register("pct_change", lambda s, d: rounded(windows.pct_change(valued(s, d), "v", "event_id"), "v_pct_change", digits=3), CHANGED)
register("pct_change_blocks", lambda s, d: rounded(windows.pct_change(valued(s, d), "v", "event_id", small_bytes=0), "v_pct_change", digits=3), CHANGED)

NULLED = "(SELECT p_partkey, nullif(p_size, 7) AS size FROM part)"
for _suffix, _bytes in (("", windows.SMALL_BYTES), ("_counted", 0)):
    for _m, _sql in [("average", "rank() OVER w + (count(*) OVER (PARTITION BY size) - 1) / 2.0"), ("first", "row_number() OVER (ORDER BY size NULLS LAST, p_partkey)")]:
        register(f"rank_{_m}_nulls{_suffix}", lambda s, d, m=_m, b=_bytes: windows.rank(table(s, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("size")), "size", m, ["p_partkey"], small_bytes=b), f"SELECT *, CASE WHEN size IS NOT NULL THEN CAST({_sql} AS DOUBLE) END AS size_rank FROM {NULLED} WINDOW w AS (ORDER BY size NULLS LAST)")
    register(f"expanding_mean_least{_suffix}", lambda s, d, b=_bytes: windows.expanding(valued(s, d), "v", "mean", "event_id", min_periods=20, small_bytes=b).withColumn("v_expanding_mean", F.round(F.col("v_expanding_mean") + 1.3e-6, 5)), f"SELECT event_id, v, CASE WHEN count(v) OVER w >= 20 THEN round(avg(v) OVER w + 1.3e-6, 5) END AS v_expanding_mean FROM {VALUED} WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
register("validate_unique_salted", lambda s, d: windows.is_first(prioritised(s, d), "p", ["o_orderkey"], small_bytes=0), f"SELECT *, p IS NULL OR row_number() OVER (PARTITION BY p ORDER BY o_orderkey) = 1 AS p_unique FROM {PRIORITISED}")
# columns of the names that operators use inside
_CLASHING = ("sum_", "count_", "bucket_", "index_", "block_", "halo_", "fine_", "place_", "value_", "ties_")
register("windows_clashing_names", lambda s, d: windows.rank(windows.expanding(rolled(s, d), "v", "sum", "event_id", small_bytes=0), "v", "first", ["event_id"], small_bytes=0).select("event_id", *_CLASHING, F.round("v_rolling_sum", 4).alias("rolled"), F.round(F.col("v_expanding_sum") + 1.3e-6, 5).alias("grown"), "v_rank"), f"SELECT event_id, {', '.join(f'event_id AS {c}' for c in _CLASHING)}, CASE WHEN count(v) OVER w = 3 THEN round(sum(v) OVER w, 4) END AS rolled, round(sum(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 1.3e-6, 5) AS grown, CASE WHEN v IS NOT NULL THEN CAST(row_number() OVER (ORDER BY v NULLS LAST, event_id) AS DOUBLE) END AS v_rank FROM {VALUED} WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")


def rolled(s, d) -> DataFrame:
    clashing = valued(s, d).withColumns({c: F.col("event_id") for c in _CLASHING})
    return windows.rolling(clashing, "v", 3, "sum", "event_id", small_bytes=0)


# dictionary encoding
register("dictionary", lambda s, d: dictionary.dictionary(prioritised(s, d), "p"), f"SELECT p AS value, row_number() OVER (ORDER BY p) - 1 AS id FROM (SELECT DISTINCT p FROM {PRIORITISED} WHERE p IS NOT NULL)")
register("dictionary_buckets", lambda s, d: dictionary.dictionary(table(s, d, "part"), "p_name", small_bytes=0), "SELECT p_name AS value, row_number() OVER (ORDER BY p_name) - 1 AS id FROM (SELECT DISTINCT p_name FROM part)")
register("dictionary_encode", lambda s, d: dictionary.encode(prioritised(s, d), "p", dictionary.dictionary(prioritised(s, d), "p")), f"SELECT o_orderkey, o_totalprice, CASE WHEN p IS NOT NULL THEN dense_rank() OVER (ORDER BY p NULLS LAST) - 1 END AS p_id FROM {PRIORITISED}")
register("dictionary_decode", lambda s, d: dictionary.decode(dictionary.encode(prioritised(s, d), "p", dictionary.dictionary(prioritised(s, d), "p")), "p", dictionary.dictionary(prioritised(s, d), "p")), f"SELECT * FROM {PRIORITISED}")
register("dictionary_savings", lambda s, d: dictionary.savings(prioritised(s, d), "p"), f"SELECT *, plain_bytes - encoded_bytes AS saved_bytes FROM (SELECT CAST(sum(n * strlen(p)) AS BIGINT) AS plain_bytes, CAST(sum(4 * n + strlen(p)) AS BIGINT) AS encoded_bytes FROM (SELECT p, count(*) AS n FROM {PRIORITISED} WHERE p IS NOT NULL GROUP BY 1))")

# strings
for _f, _args, _sql in [
    ("upper", (), "upper(p_name)"),
    ("lower", (), "lower(p_name)"),
    ("strip", (), "regexp_replace(p_name, '^\\s+|\\s+$', '', 'g')"),
    ("replace", ("a", "<>"), "replace(p_name, 'a', '<>')"),
    ("split", (" ",), "replace(p_name, ' ', '|')"),
    ("contains", ("e",), "contains(p_name, 'e')"),
    ("len", (), "strlen(p_name)"),
    ("starts_with", ("P",), "starts_with(p_name, 'P')"),
    ("ends_with", ("1",), "ends_with(p_name, '1')"),
]:
    register(f"str_{_f}", lambda s, d, f=_f, a=_args: texts.string_column(table(s, d, "part").select("p_partkey", "p_name"), "p_name", f, *a), f"SELECT p_partkey, p_name, {_sql} AS p_name_{_f} FROM part")
register("str_len_bytes", lambda s, d: texts.string_column(table(s, d, "documents").select("doc_id", "text"), "text", "len").drop("text"), "SELECT doc_id, strlen(text) AS text_len FROM documents")
register("str_cat", lambda s, d: texts.str_cat(table(s, d, "nation").select("n_nationkey", F.nullif(F.col("n_name"), F.lit("FRANCE")).alias("n")), "n", "-", "n_nationkey"), "SELECT n_nationkey, nullif(n_name, 'FRANCE') AS n, (SELECT string_agg(nullif(n_name, 'FRANCE'), '-' ORDER BY n_nationkey) FROM nation) AS n_cat FROM nation")


# dates
def dated(s, d) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(s, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("2023-02-29 01:02:03")).when(F.col("event_id") % 13 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(text).alias("t"))


DATED = "(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '2023-02-29 01:02:03' WHEN event_id % 13 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t, CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('second', ts) END AS x FROM events)"
register("to_timestamps", lambda s, d: texts.to_timestamps(dated(s, d), "t"), f"SELECT event_id, t, coalesce(CAST(epoch(x) AS BIGINT), 0) AS t_timestamp FROM {DATED}")
for _p, _sql in [("year", "year(x)"), ("month", "month(x)"), ("day", "day(x)"), ("hour", "hour(x)"), ("minute", "minute(x)"), ("second", "second(x)"), ("day_of_week", "dayofweek(x)"), ("day_of_year", "dayofyear(x)")]:
    register(f"dt_{_p}", lambda s, d, p=_p: texts.dt_part(dated(s, d), "t", p), f"SELECT event_id, t, coalesce({_sql}, 0) AS t_{_p} FROM {DATED}")
_seconds = "coalesce(CAST(epoch(x) AS BIGINT), 0)"
register("dt_diff", lambda s, d: texts.dt_diff(dated(s, d), "t", "event_id"), f"SELECT event_id, t, {_seconds} - lag({_seconds}) OVER (ORDER BY event_id) AS t_diff FROM {DATED}")
register("dt_shift", lambda s, d: texts.dt_shift(dated(s, d), "t", 3661), f"SELECT event_id, t, strftime(coalesce(x, TIMESTAMP '1970-01-01') + INTERVAL 3661 SECOND, '%Y-%m-%d %H:%M:%S') AS t_shifted FROM {DATED}")
register("timestamp_micros", lambda s, d: table(s, d, "events").select("event_id", datetimes.timestamp_micros(F.col("ts")).alias("t")), "SELECT event_id, epoch_us(ts) // 1000 AS t FROM events")
register("dt_native", lambda s, d: texts.dt_part(table(s, d, "events").select("event_id", "ts"), "ts", "hour").drop("ts"), "SELECT event_id, hour(ts) AS ts_hour FROM events")

# validity
register("validate_not_null", lambda s, d: texts.validate_not_null(prioritised(s, d), "p"), f"SELECT *, p IS NOT NULL AS p_not_null FROM {PRIORITISED}")
register("validate_range", lambda s, d: texts.validate_range(prioritised(s, d), "o_totalprice", 1000.0, 100000.0), f"SELECT *, o_totalprice BETWEEN 1000 AND 100000 AS o_totalprice_in_range FROM {PRIORITISED}")
register("validate_pattern", lambda s, d: texts.validate_pattern(prioritised(s, d), "p", "HIGH"), f"SELECT *, coalesce(contains(p, 'HIGH'), true) AS p_matches_pattern FROM {PRIORITISED}")
register("validate_unique", lambda s, d: windows.is_first(prioritised(s, d), "p", ["o_orderkey"]), f"SELECT *, p IS NULL OR row_number() OVER (PARTITION BY p ORDER BY o_orderkey) = 1 AS p_unique FROM {PRIORITISED}")
register("validation_summary", lambda s, d: rounded(texts.summary(prioritised(s, d), "p"), "null_percentage"), f"SELECT CAST(count(*) - count(p) AS DOUBLE) AS null_count, round((count(*) - count(p)) * 100.0 / count(*), 4) AS null_percentage, CAST(count(*) AS DOUBLE) AS total_count, CAST(count(p) AS DOUBLE) AS non_null_count FROM {PRIORITISED}")

# windows of time
register("tumbling_windows", lambda s, d: rounded(events.windowed(table(s, d, "events"), "ts", "1 day", ["event_type"], [("count",), ("sum", "value")]), "value_sum").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}), "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS count, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2, 3")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
