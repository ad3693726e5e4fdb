"""Tables and views: what is written comes back. Each query's table has a name of its own and is dropped when it has been read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frame import Frame
from ..plans.shared import written
from ..plans.tools import extend_dataset, to_nk
from ..sources.catalog import Database
from . import query, rounded


def _kept(t, source: str, use: Callable[[Database, Frame, str], Frame | DataFrame], kind: str = "table") -> DataFrame:
    """What `use` makes of a database, a frame and a table's name, read before the table is dropped."""
    frame = t(source)
    db, table = Database(frame.base.sparkSession), f"lakemill_{uuid.uuid4().hex[:12]}"
    try:
        out = use(db, frame, table)
        return written(out.df if isinstance(out, Frame) else out, "catalog")
    finally:
        if db.exists_table_or_view(table):
            db.drop_view(table) if kind == "view" else db.drop_table(table)


def _value(db: Database, column: str, value, kind: str) -> DataFrame:
    return db.spark.createDataFrame([(value,)], f"{column} {kind}")


query("catalog_upload", "SELECT * FROM nation")(lambda t: _kept(t, "nation", lambda db, f, name: db.upload(f.as_dataframe(), name, primary_key="n_nationkey")))
query("catalog_primary_key", "SELECT 'n_nationkey' AS key")(lambda t: _kept(t, "nation", lambda db, f, name: _value(db, "key", db.upload(f.as_dataframe(), name, primary_key="n_nationkey").get_primary_key(), "string")))


@query("catalog_append", "SELECT * FROM region UNION ALL SELECT * FROM region")
def _(t):
    def use(db, f, name):
        pdf = f.as_dataframe()
        return db.append(db.upload(pdf, name), pdf, maxnrow=2)

    return _kept(t, "region", use)


query("catalog_save_as", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")(lambda t: _kept(t, "orders", lambda db, f, name: db.save_as(f[f["o_totalprice"] > 100000][["o_orderkey", "o_totalprice"]], name)))
query("catalog_replace", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1")(lambda t: _kept(t, "nation", lambda db, f, name: db.save_as((lambda g: g[g["n_regionkey"] == 1][["n_nationkey"]])(db.save_as(f, name)), name, clear_existing=True)))


@query("catalog_rename", "SELECT * FROM supplier")
def _(t):
    def use(db, f, name):
        db.save_as(f, f"{name}_old")
        return db.rename(f"{name}_old", name)

    return _kept(t, "supplier", use)


query("catalog_view", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")(lambda t: _kept(t, "supplier", lambda db, f, name: db.create_view(f[f["s_acctbal"] < 0][["s_suppkey", "s_acctbal"]], name), "view"))
query("catalog_sql", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")(lambda t: _kept(t, "supplier", lambda db, f, name: (db.create_view(f, name), db.query(f"SELECT s_nationkey, count(*) AS n FROM {name} GROUP BY 1"))[1], "view"))
query("catalog_scalar", "SELECT count(*) AS n FROM supplier")(lambda t: _kept(t, "supplier", lambda db, f, name: (db.create_view(f, name), _value(db, "n", db.scalar_query(f"SELECT count(*) FROM {name}"), "long"))[1], "view"))
query("catalog_show", "SELECT 'T' AS \"TYPE\"")(lambda t: _kept(t, "region", lambda db, f, name: (db.save_as(f, name), db.show_tables().where(F.col("TABNAME") == name).select("TYPE"))[1]))
query("catalog_frame_kind", "SELECT true AS found, true AS is_table, false AS is_view")(lambda t: _kept(t, "region", lambda db, f, name: (lambda g: db.spark.createDataFrame([(g.exists(), g.is_table(), g.is_view())], "found boolean, is_table boolean, is_view boolean"))(db.save_as(f, name))))
query("catalog_column_id", "SELECT (r_regionkey + 0)::BIGINT AS \"ID\", r_regionkey, r_name FROM region")(lambda t: _kept(t, "region", lambda db, f, name: (db.save_as(f, name), db.add_column_id(name, destructive=True))[1]))
query("catalog_delete_column", "SELECT r_regionkey FROM region")(lambda t: _kept(t, "region", lambda db, f, name: (db.save_as(f, name), db.delete_column(name, "r_name", destructive=True))[1]))


@query("entropy_stats", "SELECT 'p_type' AS \"column\", round(log2(count(DISTINCT p_type)), 6) AS entropy FROM part")
def _(t):
    """From the catalog's statistics; the values of a text column count as equally frequent."""

    def use(db, f, name):
        db.save_as(f[["p_type"]], name)
        db.analyze(name)
        return db.entropy_stats(name)

    return rounded(_kept(t, "part", use))


query("to_nk", "SELECT 3000 AS n, (SELECT count(*) FROM supplier) AS distinct_rows")(lambda t: (lambda f: f.df.agg(F.count("*").cast("int").alias("n"), F.count_distinct("s_suppkey").alias("distinct_rows")))(to_nk(t("supplier"), 3)))
query("extend_dataset", "SELECT r_regionkey, r_name, r_regionkey AS r_regionkey_extended_2, r_name AS r_name_extended_2, r_regionkey AS r_regionkey_extended_1, r_name AS r_name_extended_1 FROM region")(lambda t: extend_dataset(t("region"), 2))
