"""A corpus pipeline: toxicity, language, near duplicates, mixture, packing. Each stage's result is written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakemill.llm import language, mixing, ngram_join, packing, toxicity
from lakemill.llm.common import cut, fold, table, uncut
from lakemill.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_TREE


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their nearest labelled examples don't call toxic. Null and empty texts stay unless most such examples are toxic."""
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.accepted(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language: those without a letter (null and empty texts too) or unlike all learned languages go."""
    return language.accepted(docs, language.fit(docs.where(fold("doc_id", 4) != 2)))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that links of 75 % of the five-word shingles connect."""
    return ngram_join.kept(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for the target mixture, whole, once for each epoch that takes them."""
    return mixing.mixed(docs, mixing.plan(docs, MIX_TREE, MIX_SHARE, MIX_EPOCHS, MIX_SEED), MIX_TREE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. Workers go on from other stages, so they remember fewer words."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, words=100_000)


#: In order. Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("language_id", known_language),
    ("ngram_jaccard", distinct_documents),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        uncut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
