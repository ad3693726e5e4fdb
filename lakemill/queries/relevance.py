"""Relevance measures and discretisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discretize, features
from . import query, rounded

_BITS = "(ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2)"


def _h(table: str, cols: str) -> str:
    return f"(SELECT {_BITS} FROM (SELECT count(*) AS n FROM {table} GROUP BY {cols}))"


_P = ["p_brand", "p_type", "p_size"]
query("entropy", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round({_h('part', c)}, 6) AS entropy" for c in _P))(lambda t: rounded(features.entropy(t("part").df, _P)))
query("entropy_raw", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((SELECT -sum(n * ln(n)) FROM (SELECT count(*) AS n FROM part GROUP BY {c})), 4) AS entropy" for c in _P))(lambda t: rounded(features.entropy(t("part").df, _P, raw=True), 4))
query("entropy_joint", f"SELECT 'p_brand,p_type' AS \"column\", round({_h('part', 'p_brand, p_type')}, 6) AS entropy")(lambda t: rounded(features.entropy(t("part").df, ["p_brand", "p_type"], joint=True)))


def _pairs(of: str, label: str, pairs, table: str = "part") -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, '{y}' AS target, round({of.format(f=_h(table, f), t=_h(table, y), ft=_h(table, f'{f}, {y}'))}, 6) AS {label}" for f, y in pairs)


_SQUARE = [(f, y) for y in _P for f in _P]
_ONE = [(f, "p_type") for f in ("p_brand", "p_size")]
query("info_gain", _pairs("{f} + {t} - {ft}", "info_gain", _ONE))(lambda t: rounded(features.info_gain(t("part").df, "p_type", ["p_brand", "p_size"])))
query("info_gain_matrix", _pairs("{f} + {t} - {ft}", "info_gain", _SQUARE))(lambda t: rounded(features.info_gain(t("part").df.select(*_P))))
query("gain_ratio", _pairs("({f} + {t} - {ft}) / ({f} + {t})", "gain_ratio", _ONE))(lambda t: rounded(features.gain_ratio(t("part").df, "p_type", ["p_brand", "p_size"])))
query("gain_ratio_asym", _pairs("({f} + {t} - {ft}) / {t}", "gain_ratio", _ONE))(lambda t: rounded(features.gain_ratio(t("part").df, "p_type", ["p_brand", "p_size"], symmetry=False)))
query("su", _pairs("2 * ({f} + {t} - {ft}) / ({f} + {t})", "su", _ONE))(lambda t: rounded(features.su(t("part").df, "p_type", ["p_brand", "p_size"])))
_OUTER = """(SELECT o_orderstatus AS "a.o_orderstatus", o_orderpriority AS "a.o_orderpriority", c_mktsegment AS "b.c_mktsegment" FROM orders FULL JOIN customer ON o_custkey = c_custkey)"""
query("outer_su", _pairs("2 * ({f} + {t} - {ft}) / ({f} + {t})", "su", [('"a.o_orderpriority"', '"a.o_orderstatus"'), ('"b.c_mktsegment"', '"a.o_orderstatus"')], _OUTER).replace("'\"", "'").replace("\"'", "'"))(lambda t: rounded(features.outer_su(t("orders").df, "o_custkey", t("customer").df, "c_custkey", "o_orderstatus", ["o_orderpriority"], ["c_mktsegment"])))
query("gini", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((SELECT 1 - sum(n * n)::DOUBLE / (sum(n) * sum(n)) FROM (SELECT count(*) AS n FROM part GROUP BY {c})), 6) AS gini" for c in _P))(lambda t: rounded(features.gini(t("part").df, _P)))
query("gini_pairwise", " UNION ALL ".join(f"SELECT '{f}' AS feature, '{y}' AS target, round((SELECT sum((c * c - s) / c) / sum(c) FROM (SELECT sum(n)::DOUBLE AS c, sum(n * n)::DOUBLE AS s FROM (SELECT {f}, {y}, count(*) AS n FROM part GROUP BY ALL) GROUP BY {f})), 6) AS gini" for f, y in _ONE))(lambda t: rounded(features.gini_pairwise(t("part").df, "p_type", ["p_brand", "p_size"])))
query("chisquared", " UNION ALL ".join(f"""SELECT '{f}' AS feature, '{y}' AS target, round((SELECT sum((n - e) * (n - e) / e) FROM (SELECT n, (sum(n) OVER (PARTITION BY {f}) * sum(n) OVER (PARTITION BY {y}))::DOUBLE / sum(n) OVER () AS e
  FROM (SELECT {f}, {y}, count(*) AS n FROM part GROUP BY ALL))), 6) AS chi2""" for f, y in _ONE))(lambda t: rounded(features.chisquared(t("part").df, "p_type", ["p_brand", "p_size"])))
_T = ["l_quantity", "l_extendedprice"]
query("ttest", " UNION ALL ".join(f"""SELECT '{f}' AS feature, round(max(abs(m - a) / (sqrt(1.0 / n + 1.0 / rows) * s)), 6) AS ttest FROM
  (SELECT l_returnflag, avg({f}) AS m, count(*) AS n FROM lineitem GROUP BY 1), (SELECT avg({f}) AS a, count(*) AS rows FROM lineitem),
  (SELECT sqrt(sum((x - mc) * (x - mc)) / (count(*) - count(DISTINCT c))) AS s FROM (SELECT l_returnflag AS c, {f} AS x, avg({f}) OVER (PARTITION BY l_returnflag) AS mc FROM lineitem))""" for f in _T))(lambda t: rounded(features.ttest(t("lineitem").df, "l_returnflag", _T)))
query("pearson_target", " UNION ALL ".join(f"SELECT '{f}' AS feature, 'l_quantity' AS target, round(corr({f}, l_quantity), 6) AS pearson FROM lineitem" for f in ("l_extendedprice", "l_tax")))(lambda t: rounded(features.pearson(t("lineitem").df, "l_quantity", ["l_extendedprice", "l_tax"])))
query("spearman", " UNION ALL ".join(f"SELECT '{f}' AS feature, 'l_quantity' AS target, round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY {f}) AS a, rank() OVER (ORDER BY l_quantity) AS b FROM lineitem)" for f in ("l_extendedprice", "l_tax")))(lambda t: rounded(features.spearman(t("lineitem").df, "l_quantity", ["l_extendedprice", "l_tax"])))


def _binned(t, **how):
    d = t("lineitem").df.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", F.col("l_extendedprice").alias("b"))
    return discretize.discretize(d, ["b"], **how).drop("l_returnflag")


_SRC = "SELECT l_orderkey, l_linenumber, l_extendedprice, {b} AS b FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)"
query("disc_ew", _SRC.format(b="(" + " + ".join(f"CASE WHEN lo + (hi - lo) * {k} / 8 < l_extendedprice THEN 1 ELSE 0 END" for k in range(1, 8)) + ")"))(lambda t: _binned(t, disc="ew", bins=8))
_STEP = "(SELECT CASE WHEN w <= base * (1 + 1e-12) THEN base WHEN w <= 2 * base * (1 + 1e-12) THEN 2 * base WHEN w <= 5 * base * (1 + 1e-12) THEN 5 * base ELSE 10 * base END FROM (SELECT w, power(10, floor(log10(w))) AS base FROM (SELECT (max(l_extendedprice) - min(l_extendedprice)) / 8 AS w FROM lineitem)))"
query("disc_ewn", f"SELECT l_orderkey, l_linenumber, l_extendedprice, (ceil(l_extendedprice / s) - 1 - floor(lo / s))::INT AS b FROM (SELECT *, greatest(l_extendedprice, floor(lo / s) * s + s * 1e-9) AS v FROM lineitem, (SELECT min(l_extendedprice) AS lo FROM lineitem), (SELECT {_STEP} AS s))")(lambda t: _binned(t, disc="ewn", bins=8))
_CUT = "(SELECT (min(v) FILTER (r = floor({q} * (n - 1) + 1)) + min(v) FILTER (r = ceil({q} * (n - 1) + 1))) / 2 FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem))"
query("disc_ef", "SELECT l_orderkey, l_linenumber, l_extendedprice, " + " + ".join(f"CASE WHEN {_CUT.format(q=q)} < l_extendedprice THEN 1 ELSE 0 END" for q in ("0.25::DOUBLE", "0.5::DOUBLE", "0.75::DOUBLE")) + " AS b FROM lineitem")(lambda t: _binned(t, disc="ef", bins=4))
query("disc_em")(lambda t: _binned(t, disc="em", target="l_returnflag"))
