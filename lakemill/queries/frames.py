"""Projection, conditions, arithmetic, rows, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.frame import Frame
from . import query, rounded

query("project_cols", "SELECT l_orderkey, l_quantity FROM lineitem")(lambda t: t("lineitem")[["l_orderkey", "l_quantity"]])
query("project_one", "SELECT o_orderpriority FROM orders")(lambda t: t("orders")["o_orderpriority"])

for _op, _sql in {"lt": "<", "le": "<=", "eq": "=", "ne": "<>", "ge": ">=", "gt": ">"}.items():

    def _filter(t, op=_op):
        f = t("lineitem")
        s = f["l_quantity"]
        cond = {"lt": s < 24, "le": s <= 24, "eq": s == 24, "ne": s != 24, "ge": s >= 24, "gt": s > 24}[op]
        return f[cond][["l_orderkey", "l_linenumber", "l_quantity"]]

    query(f"filter_{_op}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sql} 24")(_filter)


def _two(t):
    f = t("lineitem")
    return f, f["l_quantity"] < 10, f["l_discount"] > 0.05


@query("filter_and", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05")
def _(t):
    f, a, b = _two(t)
    return f[a & b][["l_orderkey", "l_linenumber"]]


@query("filter_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 OR l_discount > 0.05")
def _(t):
    f, a, b = _two(t)
    return f[a | b][["l_orderkey", "l_linenumber"]]


@query("filter_xor", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 10) <> (l_discount > 0.05)")
def _(t):
    f, a, b = _two(t)
    return f[a ^ b][["l_orderkey", "l_linenumber"]]


@query("filter_frame_conj", "SELECT l_quantity, l_linenumber FROM lineitem WHERE l_quantity < 5 AND l_linenumber < 5")
def _(t):
    f = t("lineitem")[["l_quantity", "l_linenumber"]]
    return f[f < 5]


@query("filter_after_projection", "SELECT l_orderkey FROM lineitem WHERE l_quantity * 2 >= 90")
def _(t):
    f = t("lineitem")
    return f[["l_orderkey"]][f["l_quantity"] * 2 >= 90]


@query("filter_null_dropped", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END <> '1-URGENT'")
def _(t):
    f = Frame(t("orders").df.withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))))
    return f[f["p"] != "1-URGENT"][["o_orderkey"]]


_ARITH = {
    "add": (lambda a, b: a + b, "a + b"),
    "sub": (lambda a, b: a - b, "a - b"),
    "mul": (lambda a, b: a * b, "a * b"),
    "div": (lambda a, b: a / b, "CASE WHEN b <> 0 THEN a / b END"),
    "floordiv": (lambda a, b: a // b, "CASE WHEN b <> 0 THEN floor(a / b)::BIGINT END"),
    "mod": (lambda a, b: a % b, "CASE WHEN b <> 0 THEN a % b END"),
    "pow": (lambda a, b: a**b, "power(a, b)"),
}
for _op, (_of, _sql) in _ARITH.items():

    def _series(t, of=_of):
        f = t("lineitem")
        f["r"] = of(f["l_quantity"], f["l_linenumber"])
        return rounded(f[["l_orderkey", "l_linenumber", "r"]].df)

    query(f"arith_{_op}", f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS r FROM (SELECT *, l_quantity AS a, l_linenumber AS b FROM lineitem)".replace("round(CASE WHEN b <> 0 THEN floor(a / b)::BIGINT END, 6)", "floor(a / b)::BIGINT"))(_series)

    def _scalar(t, of=_of):
        f = t("lineitem")
        f["r"] = of(7, f["l_linenumber"])
        return rounded(f[["l_orderkey", "l_linenumber", "r"]].df)

    _text = {"add": "7 + b", "sub": "7 - b", "mul": "7 * b", "div": "round(7 / b, 6)", "floordiv": "floor(7 / b)::BIGINT", "mod": "7 % b", "pow": "round(power(7, b), 6)"}[_op]
    query(f"arith_r{_op}", f"SELECT l_orderkey, l_linenumber, {_text} AS r FROM (SELECT *, l_linenumber AS b FROM lineitem)")(_scalar)


@query("arith_neg", "SELECT -l_quantity AS l_quantity FROM lineitem")
def _(t):
    return -t("lineitem")["l_quantity"]


@query("arith_frame_pair", "SELECT l_quantity + l_discount AS l_quantity, round(l_extendedprice + l_tax, 6) AS l_extendedprice FROM lineitem")
def _(t):
    f = t("lineitem")
    return rounded((f[["l_quantity", "l_extendedprice"]] + f[["l_discount", "l_tax"]]).df)


@query("arith_zero_divisor", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS r FROM lineitem")
def _(t):
    f = t("lineitem")
    f["r"] = f["l_tax"] / f["l_discount"]
    return rounded(f[["l_orderkey", "l_linenumber", "r"]].df)


@query("head_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7")
def _(t):
    return t("orders")[["o_orderkey", "o_totalprice"]].sort(["o_totalprice", "o_orderkey"]).head(7)


@query("head_default", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def _(t):
    return t("orders")[["o_orderkey", "o_totalprice"]].head()


@query("tail_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7")
def _(t):
    return t("orders")[["o_orderkey", "o_totalprice"]].sort(["o_totalprice", "o_orderkey"]).tail(7)


@query("sort_multi", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand DESC, p_size DESC, p_partkey DESC")
def _(t):
    return t("part")[["p_brand", "p_size", "p_partkey"]].sort(["p_brand", "p_size", "p_partkey"], ascending=False)


@query("sort_axis1", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
def _(t):
    return t("nation").sort(axis=1)


@query("slice_range", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def _(t):
    return t("orders")[["o_orderkey", "o_totalprice"]].sort("o_orderkey")[0:9]


@query("slice_step", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n >= 3 AND n < 40 AND (n - 3) % 5 = 0")
def _(t):
    return t("orders")[["o_orderkey"]].sort("o_orderkey")[3:40:5]


@query("slice_indexed", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def _(t):
    f = t("orders")[["o_orderkey", "o_orderstatus"]]
    f.index = "o_orderkey"
    return f[100:200]


@query("loc_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 33, 200)")
def _(t):
    f = t("orders")[["o_orderkey", "o_orderstatus"]]
    f.index = "o_orderkey"
    return f.loc[[1, 5, 33, 200]]


@query("loc_rows_cols", "SELECT o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 60")
def _(t):
    f = t("orders")
    f.index = "o_orderkey"
    return f.loc[10:60, ["o_totalprice"]]


@query("add_row_id", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS \"ID\", o_orderkey FROM orders")
def _(t):
    return t("orders")[["o_orderkey"]].add_column_id("ID", ["o_orderkey"])


@query("setitem", "SELECT p_partkey, p_size * 2 + 1 AS doubled FROM part")
def _(t):
    f = t("part")
    f["doubled"] = f["p_size"] * 2 + 1
    return f[["p_partkey", "doubled"]]


@query("delitem", "SELECT r_name FROM region")
def _(t):
    f = t("region")
    del f["r_regionkey"]
    return f


def _with_nulls(t) -> Frame:
    """Orders with nulls in two columns."""
    d = t("orders").df
    return Frame(d.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("x"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("s")))


NULLS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS x, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s FROM orders)"
query("delete_na_any", f"SELECT * FROM {NULLS} WHERE x IS NOT NULL AND s IS NOT NULL")(lambda t: _with_nulls(t).delete_na(["x", "s"]))
query("delete_na_all", f"SELECT * FROM {NULLS} WHERE x IS NOT NULL OR s IS NOT NULL")(lambda t: _with_nulls(t).delete_na(["x", "s"], "all"))


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    c = Frame(t("customer").df.withColumnRenamed("c_custkey", "o_custkey"))
    return t("orders").merge(c, "o_custkey")[["o_orderkey", "c_name"]]


@query("join_full_outer", "SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, c_name FROM orders FULL JOIN customer ON o_custkey = c_custkey")
def _(t):
    o, c = t("orders").df, t("customer").df
    left = Frame(o.select("o_custkey", "o_orderkey"))
    right = Frame(c.select(F.col("c_custkey").alias("o_custkey"), "c_name"))
    return left.merge(right, "o_custkey", "full_outer")


@query("concat", "SELECT n_nationkey AS k, n_name AS n FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(t):
    return Frame(t("nation").df.toDF("k", "n", "r").select("k", "n")).concat(Frame(t("region").df.toDF("k", "n")))


@query("rank", "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) AS rank FROM part")
def _(t):
    return t("part")[["p_partkey", "p_size"]].rank("p_size")


query("sort_nulls_first", f"SELECT o_orderkey, x FROM {NULLS} ORDER BY x NULLS FIRST, o_orderkey NULLS FIRST LIMIT 10")(lambda t: _with_nulls(t)[["o_orderkey", "x"]].sort(["x", "o_orderkey"], nulls="first")[0:9].df)
query("sort_nulls_last", f"SELECT o_orderkey, x FROM {NULLS} ORDER BY x DESC NULLS LAST, o_orderkey DESC NULLS LAST LIMIT 10")(lambda t: _with_nulls(t)[["o_orderkey", "x"]].sort(["x", "o_orderkey"], ascending=False, nulls="last")[0:9].df)
query("corrwith", "SELECT 'l_quantity' AS feature, 'l_extendedprice' AS target, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem UNION ALL SELECT 'l_tax', 'l_extendedprice', round(corr(l_tax, l_extendedprice), 6) FROM lineitem")(lambda t: rounded((lambda f: f.corrwith("l_extendedprice").where("feature <> target"))(t("lineitem")[["l_quantity", "l_extendedprice", "l_tax"]])))
query("arith_pos", "SELECT l_quantity FROM lineitem")(lambda t: +t("lineitem")["l_quantity"])
