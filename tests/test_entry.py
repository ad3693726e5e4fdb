"""The driver's entry points, and that queries agree with their SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from lakemill import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["filter_xor", "arith_floordiv", "slice_step", "stat_quantile_nulls", "within_class_var", "info_gain", "chisquared", "spearman", "disc_ef", "assoc_rules", "nb_predict", "geo_within", "join_full_outer"]


def plain(v):
    return float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.parametrize("key", SAMPLE)
def test_same_rows_as_sql(spark, sf_dir, key):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry_points.queries()[key](spark, sf_dir)
    want = con.sql(own.SQL[key])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {r["column"] for r in rows} == {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
