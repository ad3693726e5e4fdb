import re
from collections import Counter
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lakemill.llm import language, queries
from lakemill.llm.common import cut, fold

from test_operators import check_packed, jaccard_components, labels_outside, plain_language, plain_toxicity


def test_stages_on_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", None, None, 0), (900_002, None, "en", "src0", 1)], docs.schema)
    start = cols = docs.unionByName(odd).unionByName(docs.limit(5))
    cols = start.columns
    for name, stage in cp.STAGES[:-1]:
        out = cut(stage(spark, start, sf_dir), name)
        assert out.columns == cols
        if name != "mixing":
            assert 0.5 * start.count() < out.count() <= start.count()
        start = out
    pieces = cp.STAGES[-1][1](spark, start, sf_dir)
    assert pieces.select("doc_id").distinct().count() == start.select("doc_id").distinct().count()


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = cut(stage(spark, docs, sf_dir), name)
        assert out.count() == 0
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_stages_are_those_of_plain_versions(spark, sf_dir, tmp_path):
    """Every stage on its predecessor's rows, against a plain version of its decision."""
    docs = cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), "plain")
    kept = []
    for name, stage in cp.STAGES:
        out = cut(stage(spark, docs, sf_dir), f"plain-{name}")
        rows, got = docs.collect(), out.collect()
        texts = [(r["doc_id"], r["text"]) for r in rows]
        if name == "toxicity":
            score = plain_toxicity([(i, t or "") for i, t in texts], labels_outside(spark, sf_dir))
            assert {r["doc_id"] for r in got} == {i for i, _ in texts if score(i)[0] < 0.5}
        elif name == "language_id":
            model = language.fit(docs.where(fold("doc_id", 4) != 2))

            def known(text):
                if not text or not any(map(str.isalpha, text)):
                    return False
                words = " ".join(re.findall(r"(?<!\w)[^\W\d_]+(?!\w)", text)) or text
                raw = f" {words} ".lower().encode()
                grams = [int.from_bytes(raw[i : i + k], "big") + (0x9E3779B9 * k & 0xFFFFFFFF) for k in (1, 2, 3) for i in range(len(raw) - k + 1)]
                share = Counter((g * 0x85EBCA6B & 0xFFFFFFFF) >> 19 for g in grams)
                return max(sum(float(p[t]) * n for t, n in share.items()) / len(grams) for p in model.profiles) - model.least

            near = [known(t) for _, t in texts]
            assert all(abs(x) > 1e-5 or x is False for x in near)  # none is decided by rounding
            assert {r["doc_id"] for r in got} == {i for (i, _), x in zip(texts, near, strict=True) if x is not False and x >= 0}
        elif name == "ngram_jaccard":
            assert {r["doc_id"] for r in got} == {c for _, _, c, _ in jaccard_components(texts)} and len(got) < len(rows)
        elif name == "mixing":
            docs.write.parquet(str(tmp_path / "documents"))
            con = duckdb.connect()
            con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
            assert Counter(r["doc_id"] for r in got) == Counter(i for (i,) in con.sql(f"SELECT doc_id FROM ({queries.OP1_SQL})").fetchall())
        else:
            used, least = check_packed(got, texts)
            assert used <= 1.02 * least + 1
        kept.append(len(got))
        docs = out
    assert sorted(tuple(r) for r in cp.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got)


@pytest.mark.parametrize("turned", [False, True])
def test_language_stage_judges_a_text_in_the_language_that_the_machines_name(spark, sf_dir, monkeypatch, turned):
    """Against plain machines and likelihoods; machines turned round name wrong languages, in which hardly a text is likely."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    if turned:
        back = lambda d: replace(d, machines={k: replace(m, w=-m.w, b=-m.b) for k, m in d.machines.items()})
        model = replace(model, families=back(model.families), within={f: back(d) for f, d in model.within.items()})
    monkeypatch.setattr(language, "fit", lambda train: model)

    def margin(text):
        lang, _ = plain_language(model, text)
        if lang == "und":
            return None
        raw = f" {' '.join(re.findall(r'(?<!\w)[^\W\d_]+(?!\w)', text)) or text} ".lower().encode()
        grams = [int.from_bytes(raw[i : i + k], "big") + (0x9E3779B9 * k & 0xFFFFFFFF) for k in (1, 2, 3) for i in range(len(raw) - k + 1)]
        own = model.profiles[model.langs.index(lang)]
        return sum(float(own[(g * 0x85EBCA6B & 0xFFFFFFFF) >> 19]) for g in grams) / len(grams) - model.least

    plain = {r["doc_id"]: margin(r["text"]) for r in docs.collect()}
    assert all(x is None or abs(x) > 1e-5 for x in plain.values())  # none is decided by rounding
    got = [r["doc_id"] for r in cp.known_language(spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(i for i, x in plain.items() if x is not None and x >= 0)
    assert len(got) <= 0.05 * len(plain) if turned else len(got) >= 0.95 * len(plain)


def test_odd_columns_and_very_long_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    long = spark.createDataFrame([(910_000, "the of and to " * 100_000, "en", "src0", 1), (910_001, "the of and to " * 100_000, "en", "src0", 1)], docs.schema)
    start = docs.unionByName(long).withColumns({"a.b": F.lit(1), "row": F.lit("x"), "__id": F.lit(2), "key": F.lit(None).cast("string"), "score": F.lit(0.5)})
    for name, stage in cp.STAGES[:-1]:
        out = cut(stage(spark, start, sf_dir), name)
        assert out.columns == start.columns, name
        assert {910_000, 910_001} & {r["doc_id"] for r in out.select("doc_id").collect()} or name == "mixing"
        start = out if name != "mixing" else start
    assert not start.where("doc_id = 910001").take(1)
    assert cp.STAGES[-1][1](spark, start, sf_dir).count()


def test_stage_tables_go_when_the_next_is_written(spark, sf_dir):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/lakemill"
    stages = lambda: {f for f in os.listdir(folder) if f.startswith("stage-")} if os.path.isdir(folder) else set()
    before = stages()
    out = cp.run(spark, sf_dir)
    assert [f.split("-")[1] for f in stages() - before] == ["mixing"] and out.count()
