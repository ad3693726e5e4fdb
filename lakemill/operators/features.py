"""Relevance of features for a target: entropy and its relatives, Gini, chi-squared, t-statistics and correlations.

All measures of pairs come from one table of cell counts: every row gives a cell for each pair of columns asked for, and cells are
counted with a partial aggregation before the shuffle. Null is a class of its own, except in chi-squared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import correlation, name, need_numeric, numeric


def chosen(df: DataFrame, target: str | Sequence[str] | None, features: str | Sequence[str] | None, index: str | None = None) -> list[tuple[str, str]]:
    """(feature, target) pairs. All columns are the default for both; a single target is no feature of itself; the index column is left out."""
    as_list = lambda x: [x] if isinstance(x, str) else None if x is None else list(x)
    t, f = as_list(target), as_list(features)
    if unknown := [c for c in (t or []) + (f or []) if c not in df.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    if t is not None and f is not None and len(t) == len(f) == 1 and t == f:
        raise ValueError("a column is no feature of itself")
    if t is None and f is not None and len(f) == 1:
        raise ValueError("one feature needs a target")
    every = [c for c in df.columns if c != index]
    t = t or f or every
    f = f or every
    if len(t) == 1:
        f = [c for c in f if c != t[0]]
    return [(x, y) for y in t for x in f]


def cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """feature, target, f, t, n: how many rows have the values f and t (as text) in the two columns."""
    text = lambda c: name(c).cast("string")
    row = F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(y).alias("target"), text(x).alias("f"), text(y).alias("t")) for x, y in pairs])
    return df.select(F.explode(row).alias("s")).select("s.*").groupBy("feature", "target", "f", "t").agg(F.count("*").alias("n"))


def _raw(n: str) -> Column:
    return F.sum(F.col(n) * F.log(F.col(n)))


def _pair_entropies(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """feature, target, hf, ht, hft in bits."""
    c = cells(df, pairs)
    key = ["feature", "target"]
    joint = c.groupBy(*key).agg(F.sum("n").alias("rows"), _raw("n").alias("ft"))
    side = lambda v, out: c.groupBy(*key, v).agg(F.sum("n").alias("n")).groupBy(*key).agg(_raw("n").alias(out))
    t = joint.join(side("f", "f_"), key).join(side("t", "t_"), key)
    bits = lambda s: (F.log("rows") - F.col(s) / F.col("rows")) / F.log(F.lit(2.0))
    return t.select(*key, bits("f_").alias("hf"), bits("t_").alias("ht"), bits("ft").alias("hft"))


def entropy(df: DataFrame, columns: Sequence[str] | None = None, raw: bool = False, joint: bool = False) -> DataFrame:
    """column, entropy: in bits, or as the sum of -n ln n if raw. joint: one row, of the combination of all columns."""
    cols = list(columns or df.columns)
    if joint:
        counts = df.groupBy(*map(name, cols)).agg(F.count("*").alias("n")).select(F.lit(",".join(cols)).alias("column"), "n")
    else:
        flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), name(c).cast("string").alias("v")) for c in cols])).alias("s")).select("s.*")
        counts = flat.groupBy("column", "v").agg(F.count("*").alias("n"))
    total = F.sum("n")
    out = -_raw("n") if raw else (F.log(total) - _raw("n") / total) / F.log(F.lit(2.0))
    return counts.groupBy("column").agg(out.alias("entropy"))


def info_gain(df: DataFrame, target=None, features=None, index: str | None = None) -> DataFrame:
    """feature, target, info_gain = H(f) + H(t) - H(f, t)."""
    return _pair_entropies(df, chosen(df, target, features, index)).select("feature", "target", (F.col("hf") + F.col("ht") - F.col("hft")).alias("info_gain"))


def gain_ratio(df: DataFrame, target=None, features=None, symmetry: bool = True, index: str | None = None) -> DataFrame:
    """feature, target, gain_ratio: information gain over H(f) + H(t), or over H(t). Null where that is 0."""
    gain = F.col("hf") + F.col("ht") - F.col("hft")
    of = F.col("hf") + F.col("ht") if symmetry else F.col("ht")
    return _pair_entropies(df, chosen(df, target, features, index)).select("feature", "target", F.try_divide(gain, of).alias("gain_ratio"))


def su(df: DataFrame, target=None, features=None, index: str | None = None) -> DataFrame:
    """feature, target, su: symmetric uncertainty, twice the symmetric gain ratio."""
    return gain_ratio(df, target, features, True, index).select("feature", "target", (F.col("gain_ratio") * 2).alias("su"))


def outer_su(left: DataFrame, key1: str, right: DataFrame, key2: str, target: str, features1: Sequence[str], features2: Sequence[str]) -> DataFrame:
    """su over the full outer join of two tables. Columns are known as a.x and b.y; the target is one of the left table's."""
    a = left.select(*[name(c).alias(f"a.{c}") for c in left.columns])
    b = right.select(*[name(c).alias(f"b.{c}") for c in right.columns])
    joined = a.join(b, name(f"a.{key1}") == name(f"b.{key2}"), "full_outer")
    return su(joined, f"a.{target}", [f"a.{c}" for c in features1] + [f"b.{c}" for c in features2])


def gini(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """column, gini = (N^2 - sum of n^2) / N^2."""
    cols = list(features or df.columns)
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), name(c).cast("string").alias("v")) for c in cols])).alias("s")).select("s.*")
    n = F.col("n").cast("double")
    return flat.groupBy("column", "v").agg(F.count("*").alias("n")).groupBy("column").agg((1 - F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("gini"))


def gini_pairwise(df: DataFrame, target=None, features=None, index: str | None = None) -> DataFrame:
    """feature, target, gini: the mean impurity of the target within a feature's values."""
    n = F.col("n").cast("double")
    by = cells(df, chosen(df, target, features, index)).groupBy("feature", "target", "f").agg(F.sum(n).alias("c"), F.sum(n * n).alias("s"))
    return by.groupBy("feature", "target").agg((F.sum((F.col("c") * F.col("c") - F.col("s")) / F.col("c")) / F.sum("c")).alias("gini"))


def chisquared(df: DataFrame, target=None, features=None, index: str | None = None, include_empty_cells: bool = False) -> DataFrame:
    """feature, target, chi2: summed over observed cells without nulls; cells that no row has add their expected count if asked for."""
    key = ["feature", "target"]
    c = cells(df, chosen(df, target, features, index))
    r = c.groupBy(*key, "f").agg(F.sum("n").alias("r"))
    k = c.groupBy(*key, "t").agg(F.sum("n").alias("k"))
    total = c.groupBy(*key).agg(F.sum("n").alias("total"))
    x = c.where("f is not null and t is not null").join(r, [*key, "f"]).join(k, [*key, "t"]).join(total, key)
    e = F.col("r") * F.col("k") / F.col("total")
    # All expected counts of a pair add up to its rows without nulls in either, when there are no nulls.
    part = F.sum((F.col("n") - e) * (F.col("n") - e) / e)
    return x.groupBy(*key).agg((part + (F.first("total") - F.sum(e)) if include_empty_cells else part).alias("chi2"))


def ttest(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """feature, ttest: the largest distance of a class mean from the mean, in units of sqrt(1/n + 1/N) within-class deviations.

    One aggregation by class; means and squares over all rows follow from those of the classes.
    """
    cols = need_numeric(df, features if features is not None else [c for c in numeric(df) if c != target])
    if not cols:
        raise TypeError("no numeric feature")
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), name(c).cast("double").alias("x")) for c in cols])).alias("s")
    by = df.where(name(target).isNotNull()).select(name(target).alias("c"), x).select("c", "s.*").groupBy("feature", "c").agg(F.count("*").alias("n"), F.count("x").alias("m"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    free = F.when(F.sum("n") == F.count("*"), F.lit(1)).otherwise(F.sum("n") - F.count("*"))
    whole = by.groupBy("feature").agg(F.sum("n").alias("rows"), (F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("all"), F.sqrt(F.sum(F.col("m") * F.col("v")) / free).alias("s"))
    t = F.try_divide(F.abs(F.col("mean") - F.col("all")), F.sqrt(1 / F.col("n") + 1 / F.col("rows")) * F.col("s"))
    return by.join(whole, "feature").groupBy("feature").agg(F.max(t).alias("ttest"))


def pearson(df: DataFrame, target=None, features=None, index: str | None = None) -> DataFrame:
    """feature, target, pearson: one aggregation for all pairs. Null where undefined."""
    own = numeric(df)
    pairs = [(x, y) for x, y in chosen(df, target, [c for c in own if c != index] if features is None else features, index) if target is not None or y in own]
    need_numeric(df, sorted({c for p in pairs for c in p}))
    one = df.agg(*[(F.lit(1.0) if x == y else correlation(name(x), name(y))).alias(f"p{k}") for k, (x, y) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(y).alias("target"), F.col(f"p{k}").alias("pearson")) for k, (x, y) in enumerate(pairs)])).alias("s")).select("s.*")


#: Distinct values of a column whose ranks (16 bytes each) are broadcast.
BROADCAST_VALUES = 500_000


def spearman(df: DataFrame, target: str, features: Sequence[str] | None = None, ties: str = "min") -> DataFrame:
    """feature, target, spearman: Pearson's correlation of ranks; equal values share the smallest rank ('min') or the mean one ('average').

    Ranks are of values, so they are found by value: counts of distinct values, dealt in ranges, with prefix sums over ranges.
    """
    from ..plans.shared import written

    cols = need_numeric(df, features if features is not None else [c for c in numeric(df) if c != target])
    need_numeric(df, [target])
    from pyspark.sql import Window as W

    every = [target, *cols]
    # All columns' distinct values with their counts, dealt in ranges of column and value.
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), name(c).cast("double").alias("v")) for k, c in enumerate(every)])).alias("s")).select("s.*")
    counts = flat.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counts.repartitionByRange(parts, "k", "v").withColumn("part", F.spark_partition_id()), "ranks")
    base = dealt.groupBy("k", "part").agg(F.sum("n").alias("s")).select("k", "part", F.coalesce(F.sum("s").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("part", "k").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.col("base") + (1 if ties == "min" else (F.col("n") + 1) / 2)
    ranks = dealt.withColumn("before", before).join(base, ["k", "part"]).select("k", "v", rank.cast("double").alias("rank"))
    sizes = {r["k"]: r["n"] for r in dealt.groupBy("k").agg(F.count("*").alias("n")).collect()}  # a row a column
    out = df.select(*[name(c).cast("double").alias(f"v{k}") for k, c in enumerate(every)])
    for k in range(len(every)):
        own = ranks.where(F.col("k") == k).select(F.col("v").alias(f"v{k}"), F.col("rank").alias(f"r{k}"))
        # Ranks of up to a bounded number of values go to every task; beyond it both sides meet by value, where AQE splits values that many rows have.
        out = out.join(F.broadcast(own) if sizes.get(k, 0) <= BROADCAST_VALUES else own, f"v{k}", "left")
    one = out.agg(*[correlation(F.col(f"r{k + 1}"), F.col("r0")).alias(f"p{k}") for k in range(len(cols))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(target).alias("target"), F.col(f"p{k}").alias("spearman")) for k, c in enumerate(cols)])).alias("s")).select("s.*")
