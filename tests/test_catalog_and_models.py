import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakemill.operators.association import AssociationRules
from lakemill.operators.kmeans import KMeans
from lakemill.operators.naive_bayes import NaiveBayes
from lakemill.plans.frame import LakemillError
from lakemill.sources.catalog import Database, PrimaryKeyError
from lakemill.sources.samples import read_sample


@pytest.fixture()
def db(spark):
    with Database(spark) as d:
        yield d


def test_tables(db):
    pdf = pd.DataFrame({"id": [1, 2, 3], "flag": [True, False, None], "v": [0.5, None, 2.0], "s": ["a", None, "c"]})
    f = db.upload(pdf, "t_up", clear_existing=True, primary_key="id")
    assert f.dtypes == {"id": "int", "flag": "smallint", "v": "double", "s": "string"} and f.shape == (3, 4)
    with pytest.raises(NameError):
        db.upload(pdf, "t_up")
    with pytest.raises(PrimaryKeyError):
        db.upload(pd.concat([pdf, pdf]), "t_two", primary_key="id")
    assert len(db.append("t_up", pdf, maxnrow=2)) == 6
    with pytest.raises(ValueError):
        db.append("t_up", pdf[["v", "id", "flag", "s"]])
    assert db.exists_table("t_up") and db.is_table("t_up") and not db.exists_table("nope")
    db.create_view(db.frame("t_up")[["id"]], "v_up")
    assert db.exists_view("v_up") and db.is_view("v_up")
    with pytest.raises(TypeError):
        db.exists_table("v_up")
    with pytest.raises(ValueError):
        db.is_table("nope")
    with pytest.raises(TypeError):
        db.drop_table("v_up")
    db.drop_view("v_up")
    db.save_as(db.frame("t_up")[["id"]], "t_up", clear_existing=True)
    assert db.frame("t_up").columns == ["id"]
    assert db.rename("t_up", "t_new").columns == ["id"] and not db.exists_table_or_view("t_up")
    with pytest.raises(NameError):
        db.rename("t_new", "t_new")
    assert db.add_column_id("t_new", "ROWID", destructive=True).columns == ["ROWID", "id"]
    assert db.delete_column("t_new", "ROWID", destructive=True).columns == ["id"]
    assert db.add_column(db.frame("t_new"), ncat=3).columns == ["id", "COL0"]
    assert db.scalar_query("SELECT count(*) FROM t_new") == 6 and db.query("SELECT 1 AS a, 2 AS b", first_row_only=True) == (1, 2)
    assert "t_new" in [r["TABNAME"] for r in db.show_tables().collect()]
    db.drop_table("t_new")
    with pytest.raises(NameError):
        db.frame("t_new")
    with pytest.raises(ValueError):
        db.frame("bad name; drop")


def test_models_catalog(db, spark):
    db.save_model("m_one", "NaiveBayes", {"MODEL": spark.range(3).toDF("a")})
    assert db.exists_model("m_one") and db.exists_table("m_one_MODEL")
    db.drop_model("m_one")
    assert not db.exists_model("m_one") and not db.exists_table("m_one_MODEL")
    with pytest.raises(ValueError):
        db.drop_model("m_one")


def test_kmeans(spark):
    d = spark.createDataFrame([(i, float(i % 2) * 10 + i / 100, "ab"[i % 2]) for i in range(40)], "ID long, x double, s string")
    m = KMeans(2)
    got = {r["ID"]: r["CLUSTER_ID"] for r in m.fit_predict(d).collect()}
    assert all(got[i] == got[i % 2] for i in range(40)) and got[0] != got[1]
    assert sorted(m.size_clusters) == [20, 20] and m.inertia_ == pytest.approx(sum(r["WITHINSS"] for r in m.withinss.collect()))
    modes = {r["VALUE"] for r in m.tables()["COLUMN_STATISTICS"].where("STATISTIC = 'MODE'").collect()}
    assert modes == {"a", "b"}
    with pytest.raises(ValueError):
        KMeans(distance="other")
    with pytest.raises(ValueError):
        m.set_params(nope=1)


def test_naive_bayes(spark):
    d = spark.createDataFrame([(i, float(i % 10), "u" if i % 10 < 5 else "v", "L" if i % 10 < 5 else "H") for i in range(100)] + [(200, None, None, "L")], "ID long, x double, s string, t string")
    for disc in ("ew", "ef", "em"):
        m = NaiveBayes(disc=disc).fit(d, "t")
        got = {r["ID"]: r["CLASS"] for r in m.predict(d).collect()}
        assert all(got[i] == ("L" if i % 10 < 5 else "H") for i in range(100))
    p = m.predict_proba(d, mestimation=True).groupBy("ID").agg(F.sum("PROB").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in p)
    assert set(m.tables()["MODEL"].columns) == {"ATTRIBUTE", "VAL", "CLASS", "CLASSVALCOUNT", "ATTRCLASSCOUNT", "CLASSCOUNT", "TOTALCOUNT"}


def test_association_rules(spark):
    rows = [(t, i) for t in range(20) for i in (["a", "b", "c"] if t < 12 else ["a", "d"] if t < 16 else ["d"])] + [(None, "a"), (3, None), (3, "a")]
    d = spark.createDataFrame(rows, "tid long, item string")
    m = AssociationRules(minsupport=0.1, maxheadlen=2, minconf=0.5).fit(d, "tid", "item")
    by = {(tuple(r["body"]), tuple(r["head"])): r for r in m.rules.collect()}
    r = by[("b",), ("a", "c")]
    assert r["support"] == pytest.approx(0.6) and r["confidence"] == pytest.approx(1) and r["lift"] == pytest.approx(1 / 0.6)
    assert (("a",), ("d",)) not in by
    m.prune(itemsin=["c:h"], minconf=0.9)
    left = m.rules.where(~F.col("PRUNED")).collect()
    assert left and all("c" in r["head"] and r["confidence"] >= 0.9 for r in left)
    got = m.prune(reset=True).predict(d, limit=2)
    assert got.groupBy("tid").count().agg(F.max("count")).first()[0] <= 2
    assert m.predict(d, type="patterns", sort="length;support").where("tid = 0").first()["length"] == 3
    with pytest.raises(ValueError):
        AssociationRules(minconf=2)


def test_keys_statistics_and_samples(db, tmp_path):
    pdf = pd.DataFrame({"id": range(64), "v": [i % 8 for i in range(64)], "s": ["ab"[i % 2] for i in range(64)]})
    f = db.upload(pdf, "t_key", clear_existing=True, primary_key="id")
    assert f.get_primary_key() == "id" and f.exists() and f.is_table() and not f.is_view()
    assert [r["entropy"] for r in db.entropy_stats("t_key").collect()] == [None, None, None]
    db.analyze("t_key")
    got = {r["column"]: r["entropy"] for r in db.entropy_stats("t_key").collect()}
    assert got["s"] == pytest.approx(1) and got["v"] == pytest.approx(3, abs=0.3) and got["id"] > 5.7
    assert db.entropy_stats("t_key", ["s"], "raw").first()["entropy"] == pytest.approx(-64 * math.log(32))
    db.drop_table("t_key")
    db.reconnect()
    assert db.scalar_query("SELECT 1") == 1
    with pytest.raises(LakemillError):
        db.query("SELECT 1 AS a, 2 AS b").exists()
    (tmp_path / "iris.csv").write_text("sepal_length,sepal_width,petal_length,petal_width,species\n5.1,3.5,1.4,0.2,setosa\n")
    assert read_sample(db.spark, "iris", str(tmp_path / "iris.csv")).df.first()["species"] == "setosa"
    with pytest.raises(ValueError):
        read_sample(db.spark, "other", "x")


def test_rows_without_inputs_have_a_result(spark):
    d = spark.createDataFrame([(1, 1.0, "a", "L"), (2, 9.0, "b", "H"), (2, 9.5, "b", "H"), (3, None, None, "H"), (3, 1.0, "a", "L")], "ID long, x double, s string, t string")
    got = sorted((r["ID"], r["CLASS"]) for r in NaiveBayes(bins=2).fit(d, "t").predict(d).collect())
    assert got == [(1, "L"), (2, "H"), (2, "H"), (3, "H"), (3, "L")]
    k = KMeans(2).fit(d, "ID", ["x", "s"])
    rows = k.predict(d).collect()
    assert len(rows) == 5 and [r["ID"] for r in rows if r["CLUSTER_ID"] is None] == [3]
    by = {r["s"]: r["CLUSTER_ID"] for r in KMeans(2, max_iter=20).fit(d, "ID", ["s"]).predict(d).join(d, "ID").where("ID < 3").collect()}
    assert len(by) == len(set(by.values())) == 2


def test_items_with_commas_are_kept_apart(spark):
    rows = [(t, i) for t in range(10) for i in (["a,b", "c"] if t % 2 else ["a", "b,c"])]
    m = AssociationRules(minsupport=0.1, minconf=0.5).fit(spark.createDataFrame(rows, "tid long, item string"), "tid", "item")
    got = m.predict(spark.createDataFrame(rows, "tid long, item string"), limit=10)
    assert got.groupBy("tid").count().agg(F.max("count")).first()[0] == 2


def test_bayes_rows_stay_where_they_are(spark, monkeypatch):
    """Rows are not multiplied by classes and shuffled; values that predicting alone has, null inputs and equal ids count."""
    from lakemill.operators import naive_bayes

    data = [(1, "a", "u", "L"), (2, "b", "u", "H"), (2, "b", "v", "H"), (3, None, None, "H"), (3, "a", "v", "L"), (4, None, "w", "M")]
    new = spark.createDataFrame([(1, "a", "u"), (1, "z", "v"), (2, None, None)], "ID int, x string, y string")
    fitted = NaiveBayes().fit(spark.createDataFrame(data, "ID int, x string, y string, t string"), "t")
    counts = lambda c, k: {v: sum(r[k] == v and r[3] == c for r in data) for v in {r[k] for r in data} - {None}}
    for most in (10**6, 0):
        monkeypatch.setattr(naive_bayes, "MAX_SENT", most)
        for m_est in (False, True):
            got = fitted.predict_log(new, mestimation=m_est)
            if most:
                assert "hashpartitioning(ID" not in got._jdf.queryExecution().toString() and "__row" not in got._jdf.queryExecution().toString()
            want = []
            for id_, *vs in new.collect():
                for c in "HLM":
                    log = math.log(sum(r[3] == c for r in data))
                    for k, v in enumerate(vs, 1):
                        seen = counts(c, k)
                        n = sum(seen.values())
                        if v is not None and n:
                            log += math.log((seen.get(v, 0) + 1) / (n + len(seen))) if m_est else math.log((seen.get(v, 0) or 0.5) / n)
                    want.append((id_, c, round(log, 9)))
            assert sorted((r["ID"], r["CLASS"], round(r["LOGPROB"], 9)) for r in got.collect()) == sorted(want)


def test_kmeans_parts_have_a_size(spark, monkeypatch):
    """Rows of one part are dealt out to train, and their order and parts make no difference."""
    from lakemill.operators import kmeans

    monkeypatch.setattr(kmeans, "ROWS_A_PART", 100)
    trained = []
    vectors = KMeans._vectors
    monkeypatch.setattr(KMeans, "_vectors", lambda self, d: (trained.append(d), vectors(self, d))[1])
    d = spark.createDataFrame([(i, float(i % 7) + i / 999, float(i % 11)) for i in range(950)], "ID long, x double, y double")
    one = KMeans(4).fit(d.coalesce(1)).cluster_centers_
    assert trained[0].rdd.getNumPartitions() == 10 and max(trained[0].rdd.glom().map(len).collect()) < 200
    assert KMeans(4).fit(d.orderBy(F.desc("y")).repartition(3)).cluster_centers_ == [pytest.approx(c) for c in one]
