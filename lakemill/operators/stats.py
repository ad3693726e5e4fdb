"""Descriptive statistics as plans: every function takes a DataFrame and returns one, in a single pass where that is possible."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks that an approximate percentile may be off by, as a share: exact percentiles sort only that much of a column.
ACCURACY = 2000
#: Values that are sorted for one percentile, at most, unless few distinct ones hold more.
IN_BRACKET = 100_000


def name(c: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + c.replace("`", "``") + "`")


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def need_numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    own = numeric(df)
    if columns is None:
        return own
    if unknown := [c for c in columns if c not in df.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    if other := [c for c in columns if c not in own]:
        raise TypeError(f"not numeric: {other}")
    return list(columns)


def _extreme(df: DataFrame, c: str, of) -> Column:
    """Smallest or largest value; of a column that isn't numeric, null if any value is null."""
    x = name(c)
    out = of(x)
    return out if c in numeric(df) else F.when(F.count(x) == F.count(F.lit(1)), out)


STATS = {
    "count": lambda df, c: F.count(name(c)),
    "count_distinct": lambda df, c: F.count_distinct(name(c)) + F.coalesce(F.max(name(c).isNull().cast("long")), F.lit(0)),
    "levels": lambda df, c: F.count_distinct(name(c)),
    "min": lambda df, c: _extreme(df, c, F.min),
    "max": lambda df, c: _extreme(df, c, F.max),
    "sum": lambda df, c: F.sum(name(c)),
    "mean": lambda df, c: F.avg(name(c)),
    "std": lambda df, c: F.stddev_samp(name(c)),
    "var": lambda df, c: F.var_samp(name(c)),
    "nulls": lambda df, c: F.coalesce(F.sum(name(c).isNull().cast("long")), F.lit(0)),
}
#: Statistics that are of every column; the others are of numeric ones.
OF_ALL = {"count", "count_distinct", "levels", "min", "max", "nulls"}


def stat(df: DataFrame, which: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the statistic of each column. Nulls are ignored, except that count_distinct takes null as a level."""
    cols = (df.columns if columns is None else list(columns)) if which in OF_ALL else need_numeric(df, columns)
    return df.agg(*[STATS[which](df, c).alias(c) for c in cols])


def percentiles(df: DataFrame, qs: Sequence[float], columns: Sequence[str] | None = None, interpolation: str = "midpoint") -> DataFrame:
    """A row for each column and q: column, q, value.

    With n values in order and p = q(n-1)+1, 'midpoint' is the mean of those at floor(p) and ceil(p); 'linear' weighs them. Approximate
    percentiles bracket each place, again and again until at most IN_BRACKET values are inside; only those, counted by value, are sorted.
    """
    for q in qs:
        if isinstance(q, bool) or not isinstance(q, (int, float)):
            raise TypeError("q must be a number")
        if not 0 < q < 1:
            raise ValueError("q must be between 0 and 1")
    cols = need_numeric(df, columns)
    if not cols:
        raise TypeError("no numeric column")
    # Columns as c0, c1, ...: what follows is written as SQL text, which is built much faster than many small expressions.
    d = df.select(*[name(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    counts = d.selectExpr(*[f"count(c{k})" for k in range(len(cols))]).first()
    places = [_Place(k, float(q), n) for k, n in enumerate(counts) for q in qs]
    while wide := [p for p in places if p.inside > IN_BRACKET]:
        ends = d.selectExpr(*[f"percentile_approx(CASE WHEN {p.holds()} THEN c{p.col} END, array({p.ends()}), {2 * ACCURACY})" for p in wide]).first()
        kept = d.selectExpr(*[f"count_if(c{p.col} < {_sql(e[0])})" for p, e in zip(wide, ends, strict=True)], *[f"count_if(c{p.col} >= {_sql(e[0])} AND c{p.col} <= {_sql(e[1])})" for p, e in zip(wide, ends, strict=True)]).first()
        for p, (low, high), below, inside in zip(wide, ends, kept[: len(wide)], kept[len(wide) :], strict=True):
            p.narrow(low, high, below, inside)
    spark = df.sparkSession
    asked = [p for p in places if p.n]
    schema = "i int, column string, q double, lo long, hi long, part double, value double"
    known = spark.createDataFrame([(i, cols[p.col], p.q, p.lo - p.below, p.hi - p.below, p.part, p.low if p.low == p.high else None) for i, p in enumerate(places)], schema)
    search = [(i, p) for i, p in enumerate(places) if p in asked and p.low != p.high]
    if not search:
        return known.select("column", "q", "value")
    flat = d.where(" OR ".join(f"({p.holds()})" for _, p in search)).selectExpr("inline(array_compact(array(" + ", ".join(f"CASE WHEN {p.holds()} THEN struct({i} AS i, c{p.col} AS v) END" for i, p in search) + ")))")
    ranked = flat.groupBy("i", "v").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("i").orderBy("v")))
    hit = ranked.join(F.broadcast(known.drop("column", "q", "value")), "i").groupBy("i").agg(F.min(F.when(F.col("upto") >= F.col("lo"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") >= F.col("hi"), F.col("v"))).alias("b"))
    value = (F.col("a") + F.col("b")) / 2 if interpolation == "midpoint" else F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return known.join(hit, "i", "left").select("column", "q", F.coalesce("value", value).alias("value"))


def _sql(v: float) -> str:
    return f"double('{v!r}')"


class _Place:
    """Where the q-th value of a column with n values is: ranks lo and hi, of which `below` are less than low, in the bracket low to high."""

    def __init__(self, col: int, q: float, n: int) -> None:
        p = q * (n - 1) + 1
        self.col, self.q, self.n, self.lo, self.hi, self.part = col, q, n, math.floor(p), math.ceil(p), p - math.floor(p)
        self.low, self.high, self.below, self.inside = -math.inf, math.inf, 0, n

    def holds(self) -> str:
        return " AND ".join([f"c{self.col} IS NOT NULL", *([f"c{self.col} >= {_sql(self.low)}"] if self.low > -math.inf else []), *([f"c{self.col} <= {_sql(self.high)}"] if self.high < math.inf else [])])

    def ends(self) -> str:
        """Shares of the values inside between which the place is: an approximate percentile is off by one ACCURACY-th at most."""
        slack = 2.0 / ACCURACY
        return f"{max(0.0, (self.lo - self.below) / self.inside - slack):.17f}D, {min(1.0, (self.hi - self.below) / self.inside + slack):.17f}D"

    def narrow(self, low: float, high: float, below: int, inside: int) -> None:
        """A bracket that many equal values fill can't be narrowed: it ends where they are all that is left, or stays as it is."""
        if not below < self.lo or below + inside < self.hi or (low, high) == (self.low, self.high):
            self.inside = 0
            return
        self.low, self.high, self.below, self.inside = low, high, below, inside if low < high else 0


def describe(df: DataFrame, qs: Sequence[float] = (0.25, 0.5, 0.75), columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each numeric column: column, count, mean, std, min, a column 'q%' for each q, max. Without any, as describe_text() does."""
    cols = need_numeric(df, columns)
    if not cols:
        return describe_text(df)
    one = df.agg(*[F.struct(F.count(name(c)).alias("count"), F.avg(name(c)).alias("mean"), F.stddev_samp(name(c)).alias("std"), F.min(name(c)).cast("double").alias("min"), F.max(name(c)).cast("double").alias("max"), F.lit(c).alias("column")).alias(f"c{k}") for k, c in enumerate(cols)])
    rows = one.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(cols))])).alias("s")).select("s.*")
    labels = [f"{q * 100:g}%" for q in qs]
    wide = percentiles(df, qs, cols).groupBy("column").agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for q, n in zip(qs, labels, strict=True)])
    return rows.join(wide, "column", "left").select("column", "count", "mean", "std", "min", *[name(n) for n in labels], "max")


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each text column: column, count, unique (distinct values), top (the most frequent, the first of equals) and freq (its rows)."""
    cols = list(columns or categorical(df))
    if not cols:
        raise TypeError("no text column")
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), name(c).cast("string").alias("v")) for c in cols])).alias("s")).select("s.*")
    counts = flat.groupBy("column", "v").agg(F.count("v").alias("n"))
    best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))))
    by = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("v").alias("unique"), best.alias("best"))
    return by.select("column", "count", "unique", F.col("best.v").alias("top"), (-F.col("best.n")).alias("freq"))


#: What grouped() can compute.
AGGREGATES = {"count": F.count, "nunique": F.count_distinct, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "median": F.median}


def grouped(df: DataFrame, by: Sequence[str], of: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """A row for each group, rows with a null key too: the keys, then a column 'name_function' for each column and function asked for."""
    if unknown := [c for c in [*by, *of] if c not in df.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    asked = [(c, f) for c, fs in of.items() for f in ([fs] if isinstance(fs, str) else fs)]
    for c, f in asked:
        if f not in AGGREGATES:
            raise ValueError(f"no such function: {f}")
        if f in ("sum", "mean", "std", "var", "median"):
            need_numeric(df, [c])
    return df.groupBy(*map(name, by)).agg(*[AGGREGATES[f](name(c)).alias(f"{c}_{f}") for c, f in asked])


def _pairs(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[str, str]]:
    cols = need_numeric(df, columns)
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are needed")
    return list(combinations_with_replacement(cols, 2))


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _long(df: DataFrame, pairs: list[tuple[str, str]], of, label: str) -> DataFrame:
    """One aggregate for all pairs, then a row for each ordered pair. of: SQL text for two quoted columns."""
    one = df.selectExpr(*[f"{of(_quoted(a), _quoted(b))} AS p{k}" for k, (a, b) in enumerate(pairs)])
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cells = [f"struct({text(x)} AS x, {text(y)} AS y, p{k} AS {label})" for k, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return one.selectExpr(f"inline(array({', '.join(cells)}))")


def cov(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """x, y, cov: the population covariance of complete pairs, times m/(m-1) with m the smaller count of values."""

    def of(a: str, b: str) -> str:
        m = f"least(count({a}), count({b}))" if a != b else f"count({a})"
        return f"try_multiply(covar_pop(double({a}), double({b})), try_divide({m}, {m} - 1))"

    return _long(df, _pairs(df, columns), of, "cov")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of complete pairs; null, not an error, if either is constant."""
    a, b = a.cast("double"), b.cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """x, y, corr: 1 on the diagonal, null where undefined."""

    def of(a: str, b: str) -> str:
        if a == b:
            return "1.0D"
        x, y = f"CASE WHEN {b} IS NOT NULL THEN double({a}) END", f"CASE WHEN {a} IS NOT NULL THEN double({b}) END"
        return f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))"

    return _long(df, _pairs(df, columns), of, "corr")


def mad(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the mean absolute deviation from the mean of each numeric column."""
    cols = need_numeric(df, columns)
    means = df.agg(*[F.avg(name(c)) for c in cols]).first()
    return df.agg(*[F.avg(F.abs(name(c) - F.lit(m))).alias(c) for c, m in zip(cols, means, strict=True)])


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.select(name(column)).distinct()


def count_groupby(df: DataFrame, columns: Sequence[str], having: float | None = None) -> DataFrame:
    """Group sizes, those of at least `having` only."""
    if having is not None and (isinstance(having, bool) or not isinstance(having, (int, float))):
        raise TypeError("having must be a number")
    out = df.groupBy(*map(name, columns)).agg(F.count("*").alias("count"))
    return out if having is None else out.where(F.col("count") >= having)


def group_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many distinct combinations there are."""
    return df.groupBy(*map(name, columns)).agg(F.lit(1).alias("one")).agg(F.count("*").alias("levels"))


def mean_groupby(df: DataFrame, by: str, features: Sequence[str] | None = None) -> DataFrame:
    cols = need_numeric(df, features if features is not None else [c for c in numeric(df) if c != by])
    return df.groupBy(name(by)).agg(*[F.avg(name(c)).alias(c) for c in cols])


def mean_freq(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the mean of the distinct group sizes of each column, cut to a whole number."""
    cols = list(columns or df.columns)
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), name(c).cast("string").alias("v")) for k, c in enumerate(cols)])).alias("s")).select("s.*")
    sizes = flat.groupBy("k", "v").agg(F.count("*").alias("n")).select("k", "n").distinct()
    by = sizes.groupBy("k").agg(F.floor(F.avg("n")).alias("m"))
    return by.agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(c) for k, c in enumerate(cols)])


def within_class(df: DataFrame, target: str, features: Sequence[str] | None = None, root: bool = False) -> DataFrame:
    """One row: the variance (or its root) of each feature around its class means: the sum of squares over N - C, or over 1 if N equals C.

    N counts the rows whose class isn't null, C the classes. One pass: a class's sum of squares is its size times its population variance.
    """
    cols = need_numeric(df, features if features is not None else [c for c in numeric(df) if c != target])
    by = df.where(name(target).isNotNull()).groupBy(name(target)).agg(F.count("*").alias("__n"), *[F.struct(F.count(name(c)).alias("n"), F.var_pop(name(c).cast("double")).alias("v")).alias(f"c{k}") for k, c in enumerate(cols)])
    n, many = F.sum("__n"), F.count("*")
    free = F.when(n == many, F.lit(1)).otherwise(n - many)
    out = lambda k: F.sum(F.col(f"c{k}.n") * F.col(f"c{k}.v")) / free
    return by.agg(*[(F.sqrt(out(k)) if root else out(k)).alias(c) for k, c in enumerate(cols)])


def level_table(df: DataFrame, factor_threshold: int = 20) -> DataFrame:
    """column, type, factors, valtype: text with many levels is STRING, numbers with few are CATEGORICAL."""
    cols = [c for c in df.columns if c in numeric(df) or c in categorical(df)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, type string, factors long, valtype string")
    one = stat(df, "levels", cols)
    kind = lambda c: F.when(name(c) > factor_threshold, F.lit("NUMERIC" if c in numeric(df) else "STRING")).otherwise(F.lit("CATEGORICAL"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), name(c).alias("factors"), kind(c).alias("valtype")) for c in cols])).alias("s")).select("s.*")


def pivot_table(df: DataFrame, values: Sequence[str] | None, columns: Sequence[str], aggfunc: str = "count", max_entries: int | None = 1000) -> DataFrame:
    """Long form: the grouping columns, value (which column; absent values count rows) and result. More than max_entries cells are refused."""
    func = {"count": F.count, "sum": F.sum, "avg": F.avg, "average": F.avg, "mean": F.avg}.get(aggfunc.lower())
    if func is None:
        raise ValueError("aggfunc must be count, sum or mean")
    groups = df.groupBy(*map(name, columns))
    if not values:
        out = groups.agg(F.count("*").cast("double").alias("result")).select(*map(name, columns), F.lit("count").alias("value"), "result")
    else:
        if aggfunc.lower() != "count":
            need_numeric(df, values)
        wide = groups.agg(*[func(name(v)).cast("double").alias(f"__v{k}") for k, v in enumerate(values)])
        cells = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"__v{k}").alias("result")) for k, v in enumerate(values)]))
        out = wide.select(*map(name, columns), cells.alias("s")).select(*map(name, columns), "s.value", "s.result")
    if max_entries is not None and len(out.take(max_entries + 1)) > max_entries:
        raise ValueError(f"more than {max_entries} entries")
    return out


def mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the most frequent value of each column, the smallest of equally frequent ones."""
    return df.agg(*[F.mode(name(c), True).alias(c) for c in columns or df.columns])
