"""Frames, statistics and relevance against Pandas on small tables with nulls, ties and constants."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakemill.operators import discretize, features, stats
from lakemill.plans.frame import Frame, FrameError, Series

ROWS = [(1, 1.0, None, "a", -3), (2, 2.0, 2.0, None, -1), (3, None, 3.0, "a", -2), (4, 10.0, 3.0, "b", -2), (5, 3.0, 8.0, "b", 7)]


@pytest.fixture(scope="module")
def pdf():
    return pd.DataFrame(ROWS, columns=["k", "x", "y", "s", "n"])


@pytest.fixture()
def frame(spark):
    return Frame(spark.createDataFrame(ROWS, "k long, x double, y double, s string, n int"))


def col(df, c):
    return [r[c] for r in df.collect()]


def test_projection_and_conditions(frame):
    assert frame[["k", "x"]].columns == ["k", "x"] and isinstance(frame["k"], Series)
    with pytest.raises(KeyError):
        frame[["k", "nope"]]
    a, b = frame["x"] > 1, frame["n"] < 0
    assert sorted(col(frame[a & b].df, "k")) == [2, 4]
    assert sorted(col(frame[a | b].df, "k")) == [1, 2, 3, 4, 5]
    assert sorted(col(frame[a ^ b].df, "k")) == [1, 5]
    assert sorted(col(frame[frame["s"] != "a"].df, "k")) == [4, 5]
    assert sorted(col(frame[["x", "y"]][frame[["x", "y"]] > 1.5].df, "x")) == [2.0, 3.0, 10.0]
    assert sorted(col(frame[["k"]][frame["x"] > 1].df, "k")) == [2, 4, 5]
    with pytest.raises(ValueError):
        frame[Frame(frame.df)["x"] > 1]
    with pytest.raises(TypeError):
        frame["x"] < None


def test_arithmetic(frame, pdf):
    for of in (lambda a: a + 2, lambda a: 2 - a, lambda a: a * a, lambda a: a / 4, lambda a: -a, lambda a: a**2):
        got = sorted(v for v in col(of(frame["x"]).df, "x") if v is not None)
        assert got == pytest.approx(sorted(of(pdf["x"]).dropna()))
    assert col((frame["n"] // 2).df, "n") == [-2, -1, -1, -1, 3]
    assert col((frame["n"] % 3).df, "n") == [0, -1, -2, -2, 1]
    assert col((frame["n"] / 0).df, "n") == [None] * 5
    with pytest.raises(TypeError):
        frame["s"] + 1
    frame["z"] = frame["x"] + frame["y"]
    assert frame.columns[-1] == "z"
    del frame["z"]
    assert "z" not in frame.columns


def test_rows(frame):
    f = frame.sort("n")
    assert [r["k"] for r in f.head(2).collect()] in ([1, 3], [1, 4])
    assert [r["k"] for r in f.tail(1).collect()] == [5]
    assert col(frame[1:3].spark(), "k") == [2, 3, 4]
    assert col(frame.sort("k")[0:5:2].spark(), "k") == [1, 3, 5]
    frame.index = "k"
    assert col(frame.loc[[2, 5], ["s"]].df, "s") == [None, "b"]
    assert sorted(col(frame.loc[2:4].df, "k")) == [2, 3, 4]
    with pytest.raises(FrameError):
        frame.index = "n"
    with pytest.raises(ValueError):
        frame.head(0)
    with pytest.raises(ValueError):
        frame.sort("k", axis=2)
    assert col(frame.add_column_id("ID", ["k"]).spark().orderBy("ID"), "ID") == [0, 1, 2, 3, 4]
    assert sorted(col(frame.delete_na(["x", "y"]).df, "k")) == [2, 4, 5]
    assert len(frame.delete_na(["x", "y"], "all")) == 5
    assert col(frame.sort("x").spark(), "k")[-1] == 3
    assert [r["rank"] for r in frame.rank("n").df.orderBy("k").collect()] == [1, 4, 2, 2, 5]
    assert len(frame.concat(frame)) == 10 and len(frame.merge(frame[["k"]], "k")) == 5


def test_statistics(frame, pdf):
    row = lambda d: d.first().asDict()
    assert row(frame.count()) == {"k": 5, "x": 4, "y": 4, "s": 4, "n": 5}
    assert row(frame.count_distinct())["s"] == 3 and row(frame.levels())["s"] == 2
    assert row(frame.min())["s"] is None and row(frame.max())["x"] == 10
    for k, of in (("mean", "mean"), ("std", "std"), ("var", "var"), ("sum", "sum")):
        got = row(getattr(frame, k)())
        for c in "xyn":
            assert got[c] == pytest.approx(getattr(pdf[c], of)())
    assert frame["x"].mean() == 4
    assert frame["x"].quantile(0.25) == 1.5 and frame["x"].quantile(0.25, "linear") == 1.75
    q = {(r["column"], r["q"]): r["value"] for r in frame.quantile([0.1, 0.5]).collect()}
    assert q["n", 0.5] == -2 and q["y", 0.5] == 3
    with pytest.raises(ValueError):
        frame.quantile(1.5)
    with pytest.raises(TypeError):
        frame.quantile("a")
    mad = row(frame[["x", "n"]].mad())
    assert mad["n"] == pytest.approx((pdf["n"] - pdf["n"].mean()).abs().mean())
    c = {(r["x"], r["y"]): r["corr"] for r in Frame(frame.df.withColumn("c", F.lit(1.0))).corr().collect()}
    assert c["c", "x"] is None and c["x", "x"] == 1 and c["x", "y"] == pytest.approx(pdf["x"].corr(pdf["y"]))
    d = {r["column"]: r for r in frame.describe().collect()}
    assert d["x"]["25%"] == 1.5 and d["n"]["count"] == 5
    one = Frame(frame.df.where("k = 1"))
    assert row(one.std())["n"] is None and [r["cov"] for r in one.cov().collect() if r["x"] == r["y"] == "n"] == [None]
    assert row(frame.mode())["s"] == "a"
    with pytest.raises(ValueError):
        frame.pivot_table(columns="k", max_entries=2)


def test_exact_percentiles_of_many_values(spark):
    d = spark.range(20_001).select(((F.col("id") * 7919) % 20_001).cast("double").alias("v"))
    got = {r["q"]: r["value"] for r in stats.percentiles(d, [0.001, 0.25, 0.3333, 0.999]).collect()}
    for q, v in got.items():
        p = q * 20_000
        assert v == (math.floor(p) + math.ceil(p)) / 2


def test_relevance(spark, frame):
    d = spark.createDataFrame([(a, b) for a, b in [("x", 1), ("x", 1), ("y", 2), ("y", 2), ("z", 1), (None, 2)]], "a string, b int")
    assert features.info_gain(d, "b", "a").first()["info_gain"] == pytest.approx(1.0)
    assert features.gain_ratio(d, "b", "a", symmetry=False).first()["gain_ratio"] == pytest.approx(1.0)
    assert features.gini(d, ["b"]).first()["gini"] == pytest.approx(0.5)
    const = spark.createDataFrame([("x", 1), ("y", 1)], "a string, b int")
    assert features.gain_ratio(const, "b", "a", symmetry=False).first()["gain_ratio"] is None
    with pytest.raises(ValueError):
        features.info_gain(d, "b", "b")
    with pytest.raises(ValueError):
        features.info_gain(d, "c")
    with pytest.raises(TypeError):
        features.ttest(d.select("a"), "a")
    m = {(r["feature"], r["target"]): r["su"] for r in features.su(d).collect()}
    assert m["a", "b"] == pytest.approx(m["b", "a"])


def test_discretize(spark):
    d = spark.createDataFrame([(float(v), "l" if v < 50 else "h") for v in range(100)] + [(None, "h")], "v double, c string")
    assert sorted({r["v"] for r in discretize.discretize(d, ["v"], "ew", 4).collect()}, key=str) == [0, 1, 2, 3, None]
    assert discretize.cuts(d, ["v"], "em", target="c") == {"v": [49.5]}
    assert discretize.cuts(d, ["v"], "ewn", 10)["v"] == [10.0 * k for k in range(1, 10)]
    assert discretize.nice_step(0.13) == pytest.approx(0.2)
    with pytest.raises(ValueError):
        discretize.cuts(d, ["v"], "em", bins=3, target="c")
    with pytest.raises(ValueError):
        discretize.cuts(d, ["v"], "ef", target="c")


def test_cuts_by_description_length_lie_between_neighbours(spark):
    # More distinct values than were looked at before; the class changes between 7000 and 7001, and at 12345.
    d = spark.range(20_000).select(F.col("id").cast("double").alias("v"), F.when(F.col("id") <= 7000, "a").when(F.col("id") <= 12_345, "b").alias("c"))
    assert discretize.cuts(d, ["v"], "em", target="c") == {"v": [7000.5, 12345.5]}


def test_running_aggregates(spark):
    rng = random.Random(8)
    data = [(i, None if rng.random() < 0.3 else rng.randint(1, 9), rng.random()) for i in range(200)]
    f = Frame(spark.createDataFrame(data, "id long, x int, y double").repartition(7), index="id")
    want, so_far = {}, []
    for i, x, _ in data:
        so_far += [x] if x is not None else []
        want[i] = (sum(so_far), max(so_far), sum(so_far) / len(so_far)) if so_far else (None, None, None)
    got = [{r["id"]: r["x"] for r in of.df.collect()} for of in (f.cumsum(), f.cummax(), f.cummean())]
    for i, values in want.items():
        assert tuple(g[i] for g in got) == pytest.approx(values)
    back = f.sort("y", ascending=False)["x"].cumsum()
    assert [r["x"] for r in back.spark().collect()][-1] == sum(x for _, x, _ in data if x is not None)
    with pytest.raises(TypeError):
        Frame(spark.createDataFrame([("a",)], "s string")).cumsum()


def test_grouping_and_text(spark):
    f = Frame(spark.createDataFrame([("a", 1, None), ("a", 3, "u"), (None, 5, "u"), ("b", None, "v")], "k string, x int, s string"))
    got = {r["k"]: (r["x_sum"], r["s_nunique"]) for r in f.groupby("k").agg({"x": "sum", "s": ["nunique"]}).collect()}
    assert got == {"a": (4, 1), None: (5, 1), "b": (None, 1)}
    assert {r["k"]: r["count"] for r in f.groupby(["k"]).size().collect()} == {"a": 2, None: 1, "b": 1}
    for bad in ({"nope": "sum"}, {"x": "nope"}):
        with pytest.raises(ValueError):
            f.groupby("k").agg(bad)
    with pytest.raises(TypeError):
        f.groupby("k").agg({"s": "mean"})
    text = {r["column"]: tuple(r)[1:] for r in f[["k", "s"]].describe().collect()}
    assert text == {"k": (3, 2, "a", 2), "s": (3, 2, "u", 2)}
    assert {r["column"]: r["count"] for r in f.info().collect()} == {"k": 3, "x": 3, "s": 3}


def test_null_order(spark):
    f = Frame(spark.createDataFrame([(i, x) for i, x in enumerate([3, None, 1, None, 2])], "id int, x int"))
    order = lambda **k: [r["x"] for r in f.sort("x", **k).spark().collect()]
    assert order() == [1, 2, 3, None, None] and order(nulls="first") == [None, None, 1, 2, 3]
    assert order(ascending=False) == [None, None, 3, 2, 1] and order(ascending=False, nulls="last") == [3, 2, 1, None, None]
    with pytest.raises(ValueError):
        f.sort("x", nulls="middle")


def test_tools(spark, capsys):
    from lakemill.plans import tools

    f = Frame(spark.range(700).toDF("id"))
    assert len(tools.to_nk(f, 1)) == 1000 and len(tools.to_nk(Frame(spark.range(1500).toDF("id")), 1)) == 1000
    assert tools.to_nk(f, 1).df.distinct().count() == 700
    assert tools.extend_dataset(f, 2).columns == ["id", "id_extended_2", "id_extended_1"]
    assert [list(x) for x in tools.chunklist([1, 2, 3], 2)] == [[1, 2], [3]]
    tools.set_verbose(True)
    assert tools.timed(lambda: 5)() == 5 and "seconds" in capsys.readouterr().out
    assert tools.silent(tools.timed(lambda: 6))() == 6 and not capsys.readouterr().out
    tools.set_verbose(False)
    with pytest.raises(ValueError):
        tools.set_autocommit(1)


@pytest.mark.parametrize("most", [5, 60, 10_000])
def test_percentiles_by_narrowing(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "IN_BRACKET", most)
    rng = random.Random(3)
    data = [(None if rng.random() < 0.1 else rng.gauss(0, 1), rng.choice([1, 2, 2, 2, 7]), float(i)) for i in range(3000)]
    pdf = pd.DataFrame(data, columns=["x", "t", "u"])
    qs = [0.001, 0.25, 0.5, 0.731, 0.999]
    for how in ("midpoint", "linear"):
        got = {(r["column"], r["q"]): r["value"] for r in stats.percentiles(spark.createDataFrame(data, "x double, t int, u double").repartition(5), qs, None, how).collect()}
        for c in pdf:
            for q in qs:
                assert got[c, q] == pytest.approx(pdf[c].quantile(q, interpolation=how)), (c, q, how)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 400])
def test_bins_of_many_cuts(spark, n):
    cuts = sorted(random.Random(n).sample(range(1000), n))
    values = [*range(-1, 1001), *[c + 0.5 for c in cuts], None]
    df = discretize.apply_cuts(spark.createDataFrame([(v if v is None else float(v),) for v in values], "x double").withColumn("v", F.col("x")), {"x": [float(c) for c in cuts]})
    for r in df.collect():
        assert r["x"] == (None if r["v"] is None else sum(c < r["v"] for c in cuts))
