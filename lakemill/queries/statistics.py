"""Descriptive statistics."""

from __future__ import annotations

from ..operators import stats
from . import query, rounded
from .frames import NULLS, _with_nulls

NUM = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _all(of: str, cols: list[str]) -> str:
    return ", ".join(f"{of.format(c=c)} AS {c}" for c in cols)


_LINE = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
query("stat_count", f"SELECT {_all('count({c})', _LINE)} FROM lineitem")(lambda t: t("lineitem")[_LINE].count())
query("stat_count_nulls", f"SELECT {_all('count({c})', ['o_orderkey', 'x', 's'])} FROM {NULLS}")(lambda t: _with_nulls(t).count())
query("stat_count_distinct", f"SELECT {_all('count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)', ['x', 's'])} FROM {NULLS}")(lambda t: _with_nulls(t)[["x", "s"]].count_distinct())
query("stat_levels", f"SELECT {_all('count(DISTINCT {c})', ['x', 's'])} FROM {NULLS}")(lambda t: _with_nulls(t)[["x", "s"]].levels())
query("stat_unique", "SELECT DISTINCT l_shipdate FROM lineitem")(lambda t: t("lineitem").unique("l_shipdate"))
query("stat_min", f"SELECT {_all('min({c})', _LINE)} FROM lineitem")(lambda t: t("lineitem")[_LINE].min())
query("stat_max", f"SELECT {_all('max({c})', _LINE)} FROM lineitem")(lambda t: t("lineitem")[_LINE].max())
query("stat_min_nulls", f"SELECT min(x) AS x, CASE WHEN count(s) = count(*) THEN min(s) END AS s FROM {NULLS}")(lambda t: _with_nulls(t)[["x", "s"]].min())
query("stat_sum", f"SELECT sum(l_linenumber)::BIGINT AS l_linenumber, {_all('round(sum({c}), 4)', NUM[1:])} FROM lineitem")(lambda t: rounded(t("lineitem")[NUM].sum(), 4))
for _k, _sql in {"mean": "avg({c})", "std": "stddev_samp({c})", "var": "var_samp({c})", "median": None}.items():
    if _sql:
        query(f"stat_{_k}", f"SELECT {_all(f'round({_sql}, 4)', NUM)} FROM lineitem")(lambda t, k=_k: rounded(getattr(t("lineitem")[NUM], k)(), 4))
query("stat_nulls", f"SELECT {_all('(count(*) - count({c}))::BIGINT', ['o_orderkey', 'x', 's'])} FROM {NULLS}")(lambda t: _with_nulls(t).nulls())


def _midpoint(source: str, columns: list[str], qs: list[float]) -> str:
    each = [f"""SELECT '{c}' AS "column", {q}::DOUBLE AS q, round((min(v) FILTER (r = floor({q}::DOUBLE * (n - 1) + 1)) + min(v) FILTER (r = ceil({q}::DOUBLE * (n - 1) + 1))) / 2, 6) AS value
      FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {source} WHERE {c} IS NOT NULL)""" for c in columns for q in qs]
    return " UNION ALL ".join(each)


query("stat_median", _midpoint("lineitem", NUM, [0.5]))(lambda t: rounded(t("lineitem")[NUM].median()))
query("stat_quantile", _midpoint("lineitem", NUM, [0.1, 0.25, 0.9]))(lambda t: rounded(t("lineitem")[NUM].quantile([0.1, 0.25, 0.9])))
query("stat_quantile_nulls", _midpoint(NULLS, ["x"], [0.33]))(lambda t: rounded(_with_nulls(t)[["x"]].quantile([0.33])))
query("stat_quantile_linear", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 0.25::DOUBLE AS q, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS value FROM lineitem" for c in NUM))(lambda t: rounded(t("lineitem")[NUM].quantile([0.25], "linear")))
_DESC = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min,
  (SELECT round(value, 4) FROM ({_midpoint('lineitem', [c], [0.25])})) AS "25%", (SELECT round(value, 4) FROM ({_midpoint('lineitem', [c], [0.5])})) AS "50%", (SELECT round(value, 4) FROM ({_midpoint('lineitem', [c], [0.75])})) AS "75%", max({c})::DOUBLE AS max FROM lineitem"""
    for c in NUM
)
query("describe", _DESC)(lambda t: rounded(t("lineitem")[NUM].describe(), 4))
_SQUARE = [(a, b) for a in NUM for b in NUM]
query("cov", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}), 4) + 0.0 AS cov FROM lineitem" for a, b in _SQUARE))(lambda t: rounded(t("lineitem")[NUM].cov(), 4))
query("corr", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({'any_value(1.0::DOUBLE)' if a == b else f'corr({a}, {b})'}, 6) + 0.0 AS corr FROM lineitem" for a, b in _SQUARE))(lambda t: rounded(t("lineitem")[NUM].corr()))
query("mad", f"SELECT {_all('round(avg(abs({c} - m_{c})), 4)', NUM)} FROM lineitem, (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in NUM)} FROM lineitem)")(lambda t: rounded(t("lineitem")[NUM].mad(), 4))
query("count_groupby", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")(lambda t: t("lineitem").count_groupby(["l_returnflag", "l_linestatus"]))
query("count_groupby_having", "SELECT p_brand, count(*) AS count FROM part GROUP BY ALL HAVING count(*) >= 80")(lambda t: t("part").count_groupby("p_brand", 80))
query("group_levels", "SELECT count(*) AS levels FROM (SELECT DISTINCT p_brand, p_type FROM part)")(lambda t: stats.group_levels(t("part").df, ["p_brand", "p_type"]))
query("mean_groupby", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY ALL")(lambda t: rounded(t("orders").mean_groupby("o_orderpriority", ["o_totalprice"]), 4))
query("mean_freq", "SELECT (SELECT floor(avg(DISTINCT n))::BIGINT FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) AS p_brand, (SELECT floor(avg(DISTINCT n))::BIGINT FROM (SELECT count(*) AS n FROM part GROUP BY p_type)) AS p_type")(lambda t: t("part").mean_freq_of_instance(["p_brand", "p_type"]))
_WITHIN = "SELECT {r}(sum((x - m) * (x - m)) / (count(*) - count(DISTINCT c))) FROM (SELECT l_returnflag AS c, {f} AS x, avg({f}) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)"
for _k, _r in (("var", ""), ("std", "sqrt")):
    query(f"within_class_{_k}", "SELECT " + ", ".join(f"round(({_WITHIN.format(r=_r, f=c)}), 4) AS {c}" for c in ("l_quantity", "l_extendedprice")))(lambda t, k=_k: rounded(getattr(t("lineitem"), f"within_class_{k}")("l_returnflag", ["l_quantity", "l_extendedprice"]), 4))
query("pivot_count", "SELECT l_returnflag, l_linestatus, 'count' AS value, count(*)::DOUBLE AS result FROM lineitem GROUP BY ALL")(lambda t: t("lineitem").pivot_table(columns=["l_returnflag", "l_linestatus"]))
query("pivot_sum", "SELECT l_returnflag, 'l_quantity' AS value, round(sum(l_quantity), 4) AS result FROM lineitem GROUP BY ALL")(lambda t: rounded(t("lineitem").pivot_table("l_quantity", "l_returnflag", aggfunc="sum"), 4))
query("pivot_avg", "SELECT l_returnflag, 'l_quantity' AS value, round(avg(l_quantity), 6) AS result FROM lineitem GROUP BY ALL")(lambda t: rounded(t("lineitem").pivot_table("l_quantity", "l_returnflag", aggfunc="Mean")))
query("pivot_multi", " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{c}' AS value, round(avg({c}), 6) AS result FROM lineitem GROUP BY ALL" for c in ("l_quantity", "l_tax")))(lambda t: rounded(t("lineitem").pivot_table(["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"], aggfunc="avg")))
query("level_table", "SELECT 'p_brand' AS \"column\", 'string' AS type, count(DISTINCT p_brand) AS factors, CASE WHEN count(DISTINCT p_brand) > 20 THEN 'STRING' ELSE 'CATEGORICAL' END AS valtype FROM part UNION ALL SELECT 'p_size', 'int', count(DISTINCT p_size), CASE WHEN count(DISTINCT p_size) > 20 THEN 'NUMERIC' ELSE 'CATEGORICAL' END FROM part")(lambda t: stats.level_table(t("part").df.select("p_brand", "p_size")))
query("mode", "SELECT (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p_brand, (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p_size")(lambda t: t("part")[["p_brand", "p_size"]].mode())
query("groupby_agg", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_mean, count(DISTINCT l_linenumber) AS l_linenumber_nunique, max(l_shipdate) AS l_shipdate_max FROM lineitem GROUP BY ALL")(
    lambda t: rounded(t("lineitem").groupby(["l_returnflag", "l_linestatus"]).agg({"l_quantity": ["sum", "mean"], "l_linenumber": "nunique", "l_shipdate": "max"}), 4)
)
query("groupby_std", "SELECT o_orderpriority, round(stddev_samp(o_orderkey), 4) AS o_orderkey_std, round(stddev_samp(o_custkey), 4) AS o_custkey_std, round(stddev_samp(o_totalprice), 4) AS o_totalprice_std FROM orders GROUP BY ALL")(lambda t: rounded(t("orders").groupby("o_orderpriority").std(), 4))
query("groupby_size", "SELECT n_regionkey, count(*) AS count FROM nation GROUP BY ALL")(lambda t: t("nation").groupby("n_regionkey").size())
query("describe_text", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, count(DISTINCT {c}) AS \"unique\", (SELECT {c} FROM {s} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top, (SELECT count(*) FROM {s} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS freq FROM {s}" for s, c in (("part", "p_brand"), ("part", "p_type"))))(lambda t: t("part")[["p_brand", "p_type"]].describe())
query("describe_text_nulls", f"SELECT 's' AS \"column\", count(s) AS count, count(DISTINCT s) AS \"unique\", (SELECT s FROM {NULLS} WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top, (SELECT count(*) FROM {NULLS} WHERE s IS NOT NULL GROUP BY s ORDER BY 1 DESC LIMIT 1) AS freq FROM {NULLS}")(lambda t: _with_nulls(t)[["s"]].describe_text())
query("info", "SELECT 'n_nationkey' AS \"column\", 'int' AS type, count(n_nationkey) AS count FROM nation UNION ALL SELECT 'n_name', 'string', count(n_name) FROM nation")(lambda t: t("nation")[["n_nationkey", "n_name"]].info())


def _indexed(t, cols=("o_totalprice",)):
    f = t("orders")[["o_orderkey", *cols]]
    f.index = "o_orderkey"
    return f


for _k, _sql in {"cumsum": "round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2)", "cummax": "max(o_totalprice) OVER (ORDER BY o_orderkey)", "cummin": "min(o_totalprice) OVER (ORDER BY o_orderkey)", "cummean": "round(avg(o_totalprice) OVER (ORDER BY o_orderkey), 2)"}.items():
    query(_k, f"SELECT o_orderkey, {_sql} AS o_totalprice FROM orders")(lambda t, k=_k: rounded(getattr(_indexed(t), k)().df, 2))
query("cumsum_nulls", f"SELECT o_orderkey, round(sum(x) OVER (ORDER BY o_orderkey), 2) AS x FROM {NULLS} WHERE o_orderkey IS NOT NULL")(lambda t: rounded(_null_sums(t).df, 2))
query("cumprod", "SELECT r_regionkey, product(r_regionkey + 1) OVER (ORDER BY r_regionkey) AS n FROM region")(lambda t: _products(t).df)


def _null_sums(t):
    f = _with_nulls(t).delete_na("o_orderkey")[["o_orderkey", "x"]]
    f.index = "o_orderkey"
    return f.cumsum()


def _products(t):
    f = t("region")[["r_regionkey"]]
    f["n"] = f["r_regionkey"] + 1
    f.index = "r_regionkey"
    return f.cumprod()
