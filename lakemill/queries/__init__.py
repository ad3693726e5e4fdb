"""Registered queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import name
from ..plans.frame import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of a table opener t(name) -> Frame."""

    def put(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda t: Frame(spark.read.parquet(f"{sf_dir}/{t}.parquet")))
            return out.spark() if isinstance(out, Frame) else out

        run.__name__ = key
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without minus zero: sums differ in their last bits by the order of rows."""
    return df.select(*[(F.round(name(c), digits) + F.lit(0.0)).alias(c) if t == "double" else name(c) for c, t in df.dtypes])


def register() -> None:
    from . import catalogs, frames, geo, learning, relevance, statistics  # noqa: F401
