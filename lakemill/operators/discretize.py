"""Discretisation of numeric columns: equal width, nice equal width, equal frequency, and minimal description length."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import prefix_sums, written
from .stats import name, need_numeric, percentiles


def nice_step(width: float) -> float:
    """The smallest of 1, 2, 5 times a power of ten that is at least width."""
    base = 10.0 ** math.floor(math.log10(width))
    return next(m * base for m in (1, 2, 5, 10) if m * base >= width * (1 - 1e-12))


def cuts_equal_width(df: DataFrame, columns: Sequence[str], bins: int, nice: bool = False) -> dict[str, list[float]]:
    got = df.agg(*[F.struct(F.min(name(c)).cast("double"), F.max(name(c)).cast("double")) for c in columns]).first()
    out = {}
    for c, (lo, hi) in zip(columns, got, strict=True):
        if lo is None or lo == hi:
            out[c] = []
        elif nice:
            step = nice_step((hi - lo) / bins)
            first = math.floor(lo / step) + 1
            out[c] = [k * step for k in range(first, math.ceil(hi / step))]
        else:
            out[c] = [lo + (hi - lo) * k / bins for k in range(1, bins)]
    return out


def cuts_equal_frequency(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    rows = percentiles(df, [k / bins for k in range(1, bins)], columns).collect()
    return {c: sorted({r["value"] for r in rows if r["column"] == c and r["value"] is not None}) for c in columns}


def _entropy(counts: Sequence[float]) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0


def mdl_cuts(table: DataFrame, classes: int) -> list[float]:
    """Cuts between neighbouring values that Fayyad and Irani's criterion accepts.

    table: v, c0, c1, ... (counts of v by class), one row a value. Prefix sums are made once; each round every open interval finds its best cut by one
    aggregation, so the driver gets a row an interval and never the values.
    """
    names = [f"c{k}" for k in range(classes)]
    sums = table
    for c in names:
        sums = prefix_sums(sums, "v", c, f"s{c}")
    sums = written(sums.select("v", *[(F.col(f"s{c}") + F.col(c)).alias(c) for c in names]), "class-sums")
    top = sums.agg(F.max("v"), *[F.max(c) for c in names]).first()
    out: list[float] = []
    # An interval: values above lo (None: all) up to hi, with the prefix sums at both ends.
    todo = [(None, top[0], [0] * classes, list(top[1:]))] if top[0] is not None else []
    while todo:
        # The interval of a value, by its number among the open ones, which lie in ascending order.
        todo.sort(key=lambda t: t[1])
        at = F.lit(len(todo)) - F.size(F.filter(F.lit([float(t[1]) for t in todo]), lambda h: h >= F.col("v")))
        ends = F.array(*[F.struct(F.lit(t[0]).cast("double").alias("lo"), F.lit(t[1]).alias("hi"), F.array(*[F.lit(float(x)) for x in t[2]]).alias("a"), F.array(*[F.lit(float(x)) for x in t[3]]).alias("b")) for t in todo])
        rows = sums.where(F.col("v") <= todo[-1][1]).withColumn("k", at).withColumn("e", F.get(ends, F.col("k"))).where("e.lo is null or v > e.lo")

        def part(xs: list[Column]) -> Column:
            n = sum(xs[1:], xs[0])
            return sum((F.when(x > 0, -x * F.log2(x / n)).otherwise(0.0) for x in xs[1:]), F.when(xs[0] > 0, -xs[0] * F.log2(xs[0] / n)).otherwise(0.0))

        left = [F.col(c) - F.col("e.a")[k] for k, c in enumerate(names)]
        right = [F.col("e.b")[k] - F.col(c) for k, c in enumerate(names)]
        # Equal cuts differ by rounding only: the lowest value wins.
        best = rows.where("v < e.hi").groupBy("k").agg(F.min(F.struct(F.round(part(left) + part(right), 6).alias("h"), F.col("v").alias("v"), *names)).alias("m")).select("k", "m.*")
        found = {r["k"]: r for r in best.collect()}
        after = {}
        if found:
            chosen = F.get(F.array(*[F.lit(found[k]["v"] if k in found else None).cast("double") for k in range(len(todo))]), F.col("k"))
            after = {r["k"]: r["n"] for r in rows.where(F.col("v") > chosen).groupBy("k").agg(F.min("v").alias("n")).collect()}
        more = []
        for k, (lo, hi, a, b) in enumerate(todo):
            if k not in found:
                continue
            at = [found[k][c] for c in names]
            total, l, r = ([y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, at)], [y - x for x, y in zip(at, b)])
            n, h, h1, h2 = sum(total), _entropy(total), _entropy(l), _entropy(r)
            e = (sum(l) * h1 + sum(r) * h2) / n
            kinds = [sum(x > 0 for x in c) for c in (total, l, r)]
            delta = math.log2(3.0 ** kinds[0] - 2) - (kinds[0] * h - kinds[1] * h1 - kinds[2] * h2)
            if h - e > (math.log2(n - 1) + delta) / n:
                v = found[k]["v"]
                out.append((v + after[k]) / 2)
                more += [(lo, v, a, at), (v, hi, at, b)]
        todo = more
    return sorted(out)


def cuts_mdl(df: DataFrame, columns: Sequence[str], target: str) -> dict[str, list[float]]:
    """Class-dependent cuts between any two neighbouring values, however many there are. The driver gets the classes."""
    out = {}
    for c in columns:
        rows = df.where(name(c).isNotNull()).select(name(c).cast("double").alias("v"), name(target).cast("string").alias("t"))
        classes = [r["t"] for r in rows.select("t").distinct().collect()]
        counts = [F.sum(F.col("t").eqNullSafe(F.lit(t)).cast("long")).alias(f"c{k}") for k, t in enumerate(classes)]
        out[c] = mdl_cuts(rows.groupBy("v").agg(*counts), len(classes)) if classes else []
    return out


def discretize(df: DataFrame, columns: Sequence[str] | None = None, disc: str = "ew", bins: int | None = None, target: str | None = None) -> DataFrame:
    """df with each column replaced by its bin (0, 1, ...): a value equal to a cut is in the bin below. Null stays null.

    disc: 'ew' equal width, 'ewn' equal width with round cuts, 'ef' equal frequency, 'em' by description length given the target.
    """
    cols = need_numeric(df, [c for c in columns if c != target] if columns else None)
    cols = [c for c in cols if c != target]
    found = cuts(df, cols, disc, bins, target)
    return apply_cuts(df, found)


def cuts(df: DataFrame, columns: Sequence[str], disc: str, bins: int | None = None, target: str | None = None) -> dict[str, list[float]]:
    if disc == "em":
        if target is None or bins is not None:
            raise ValueError("'em' needs a target and takes no number of bins")
        return cuts_mdl(df, columns, target)
    if target is not None:
        raise ValueError(f"{disc!r} takes no target")
    if disc == "ef":
        return cuts_equal_frequency(df, columns, bins or 10)
    if disc in ("ew", "ewn"):
        return cuts_equal_width(df, columns, bins or 10, disc == "ewn")
    raise ValueError(f"unknown discretisation {disc!r}")


def _below(x: Column, cuts: list[float]) -> Column:
    """How many cuts are less than x: among every so many of the ascending cuts first, then among those that follow the last such one."""
    if not cuts:
        return F.lit(0)
    every = math.isqrt(len(cuts))
    edges, coarse = (F.array(*map(F.lit, v)) for v in (cuts, cuts[::every]))
    steps = F.size(F.filter(coarse, lambda e: e < x))
    start = (steps - 1) * every
    return F.when(steps == 0, 0).otherwise(start + F.size(F.filter(F.slice(edges, F.greatest(start, F.lit(0)) + 1, F.lit(every)), lambda e: e < x)))


def apply_cuts(df: DataFrame, found: dict[str, list[float]]) -> DataFrame:
    out = []
    for c in df.columns:
        if c in found:
            x = name(c).cast("double")
            out.append(F.when(x.isNotNull(), _below(x, found[c])).alias(c))
        else:
            out.append(name(c))
    return df.select(*out)
