"""Models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.association import AssociationRules
from ..operators.kmeans import KMeans
from ..operators.naive_bayes import NaiveBayes
from . import query, rounded

_BASKETS = "(SELECT DISTINCT o_custkey AS tid, o_orderpriority AS item FROM orders)"
_FREQ = f"""b AS {_BASKETS}, n AS (SELECT count(DISTINCT tid) AS n FROM b),
f1 AS (SELECT [item] AS items, count(*) AS freq FROM b GROUP BY item), f2 AS (SELECT [x.item, y.item] AS items, count(*) AS freq FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item GROUP BY x.item, y.item),
f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2)"""


def _rules(t) -> AssociationRules:
    return AssociationRules(minsupport=0.05, maxlen=2, minconf=0.1).fit(t("orders").df, "o_custkey", "o_orderpriority")


@query("assoc_patterns", f"WITH {_FREQ} SELECT array_to_string(items, ',') AS items, freq FROM f, n WHERE freq >= 0.05 * n")
def _(t):
    return _rules(t).patterns.select(F.array_join("items", ",").alias("items"), "freq")


_RULES = f"""WITH {_FREQ}, r AS (SELECT b1.items[1] AS body, h.items[1] AS head, p.freq / n::DOUBLE AS support, p.freq / b1.freq::DOUBLE AS confidence, p.freq / b1.freq::DOUBLE / (h.freq / n::DOUBLE) AS lift
FROM f2 p JOIN f1 b1 ON list_contains(p.items, b1.items[1]) JOIN f1 h ON list_contains(p.items, h.items[1]) AND h.items[1] <> b1.items[1], n WHERE p.freq >= 0.05 * n AND p.freq / b1.freq::DOUBLE >= 0.1)"""


@query("assoc_rules", f"{_RULES} SELECT body, head, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM r")
def _(t):
    return rounded(_rules(t).rules.select(F.array_join("body", ",").alias("body"), F.array_join("head", ",").alias("head"), "support", "confidence", "lift"))


@query("assoc_predict", f"""{_RULES} SELECT tid, body, head, round(support, 6) AS support FROM (SELECT tid, body, head, support, row_number() OVER (PARTITION BY tid ORDER BY support DESC, confidence DESC, body || '|' || head) AS k
FROM b JOIN r ON b.item = r.body) WHERE k = 1""")
def _(t):
    out = _rules(t).predict(t("orders").df)
    return rounded(out.select("tid", F.array_join("body", ",").alias("body"), F.array_join("head", ",").alias("head"), "support"))


_NB_IN = ["p_brand", "p_size"]


def _bayes(t) -> NaiveBayes:
    return NaiveBayes(bins=5).fit(t("part").df, "p_type", "p_partkey", _NB_IN)


_NB = """c AS (SELECT p_partkey, p_type, p_brand, (CASE WHEN lo + (hi - lo) * 1 / 5 < p_size THEN 1 ELSE 0 END + CASE WHEN lo + (hi - lo) * 2 / 5 < p_size THEN 1 ELSE 0 END + CASE WHEN lo + (hi - lo) * 3 / 5 < p_size THEN 1 ELSE 0 END + CASE WHEN lo + (hi - lo) * 4 / 5 < p_size THEN 1 ELSE 0 END)::VARCHAR AS b
  FROM part, (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part)),
x AS (SELECT p_partkey, p_type, 'p_brand' AS a, p_brand AS v FROM c UNION ALL SELECT p_partkey, p_type, 'p_size', b FROM c),
m AS (SELECT a, v, p_type, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)"""


@query("nb_model", f"WITH {_NB} SELECT a AS \"ATTRIBUTE\", v AS \"VAL\", m.p_type AS \"CLASS\", m.n AS \"CLASSVALCOUNT\", k.n AS \"ATTRCLASSCOUNT\", k.n AS \"CLASSCOUNT\", (SELECT count(*) FROM part) AS \"TOTALCOUNT\" FROM m JOIN k USING (p_type)")
def _(t):
    return _bayes(t).tables()["MODEL"]


_LOGS = f"""WITH {_NB}, l AS (SELECT x.p_partkey, k.p_type, sum(ln(coalesce(m.n, 0.5)::DOUBLE / k.n)) + ln(any_value(k.n)) AS l
FROM x CROSS JOIN k LEFT JOIN m ON m.a = x.a AND m.v = x.v AND m.p_type = k.p_type GROUP BY 1, 2)"""


@query("nb_predict", f"{_LOGS} SELECT p_partkey AS \"ID\", arg_min(p_type, (-round(l, 9), p_type)) AS \"CLASS\" FROM l GROUP BY 1")
def _(t):
    return _bayes(t).predict(t("part").df)


@query("nb_predict_proba", f"{_LOGS} SELECT p_partkey AS \"ID\", p_type AS \"CLASS\", round(exp(l) / sum(exp(l)) OVER (PARTITION BY p_partkey), 6) AS \"PROB\" FROM l")
def _(t):
    return rounded(_bayes(t).predict_proba(t("part").df))


@query("kmeans_predict")
def _(t):
    return KMeans(4).fit_predict(t("customer").df.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n")), "c_custkey")


@query("kmeans_clusters")
def _(t):
    return KMeans(4, distance="norm_euclidean").fit(t("customer").df.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey").tables()["CLUSTERS"]


@query("assoc_prune", f"{_RULES} SELECT body, head, NOT (support >= 0.2 AND round(lift, 9) >= 0.9) AS \"PRUNED\" FROM r")
def _(t):
    out = _rules(t).prune(minsupport=0.2, minlift=0.9).rules
    return out.select(F.array_join("body", ",").alias("body"), F.array_join("head", ",").alias("head"), "PRUNED")


@query("assoc_predict_patterns", f"""WITH {_FREQ}, p AS (SELECT items, freq / n::DOUBLE AS support, len(items) AS length, CASE WHEN len(items) = 1 THEN 1.0 ELSE freq / n::DOUBLE / ((SELECT freq FROM f1 WHERE items[1] = f.items[1]) / n::DOUBLE * (SELECT freq FROM f1 WHERE items[1] = f.items[2]) / n::DOUBLE) END AS lift FROM f, n WHERE freq >= 0.05 * n),
h AS (SELECT b.tid, p.* FROM b JOIN p ON list_contains(p.items, b.item)), w AS (SELECT tid, items, support, length, lift FROM h GROUP BY ALL HAVING count(*) = length)
SELECT tid, items, round(support, 6) AS support, length::INT AS length FROM (SELECT tid, array_to_string(items, ',') AS items, support, length, row_number() OVER (PARTITION BY tid ORDER BY support DESC, round(lift, 9) DESC, length DESC, array_to_string(items, ',')) AS k FROM w) WHERE k = 1""")
def _(t):
    out = _rules(t).predict(t("orders").df, type="patterns")
    return rounded(out.select("tid", F.array_join("items", ",").alias("items"), "support", "length"))


@query("assoc_items", f"WITH {_FREQ} SELECT items[1] AS \"ITEM\", freq AS \"COUNT\" FROM f1, n WHERE freq >= 0.05 * n")
def _(t):
    return _rules(t).tables()["ITEMS"]


@query("nb_m_estimate", f"""WITH {_NB}, v AS (SELECT a, count(DISTINCT v) AS m FROM m GROUP BY 1), l AS (SELECT x.p_partkey, k.p_type, sum(ln((coalesce(m.n, 0) + 1)::DOUBLE / (k.n + v.m))) + ln(any_value(k.n)) AS l
FROM x CROSS JOIN k JOIN v ON v.a = x.a LEFT JOIN m ON m.a = x.a AND m.v = x.v AND m.p_type = k.p_type GROUP BY 1, 2) SELECT p_partkey AS "ID", p_type AS "CLASS", round(exp(l) / sum(exp(l)) OVER (PARTITION BY p_partkey), 6) AS "PROB" FROM l""")
def _(t):
    return rounded(_bayes(t).predict_proba(t("part").df, mestimation=True))


@query("nb_labels", f"{_LOGS} SELECT p_partkey AS \"ID\", arg_min(p_type, (-round(l, 9), p_type)) AS \"CLASS\" FROM l GROUP BY 1")
def _(t):
    return _bayes(t).labels_


@query("kmeans_nominal", "SELECT c_custkey AS \"ID\", dense_rank() OVER (ORDER BY c_mktsegment)::INT AS segment, 0.0::DOUBLE AS \"DISTANCE\" FROM customer")
def _(t):
    """As many clusters as segments, with the segment as only input: a cluster is a segment, whatever its number."""
    rows = t("customer").df.select("c_custkey", "c_mktsegment")
    out = KMeans(5, max_iter=50).fit_predict(rows, "c_custkey").join(rows, F.col("ID") == F.col("c_custkey"))
    first = out.groupBy("CLUSTER_ID").agg(F.min("c_mktsegment").alias("s"))
    from pyspark.sql import Window as W

    named = first.withColumn("segment", F.dense_rank().over(W.orderBy("s")))
    return rounded(out.join(named, "CLUSTER_ID").select("ID", "segment", "DISTANCE"))
