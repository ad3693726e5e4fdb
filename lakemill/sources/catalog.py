"""Tables and views of a Spark catalog: listing, upload, append, renaming, dropping, models.

There are no transactions: commit() and rollback() do nothing. Table names have letters, digits and underscores, and at most one dot.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import name
from ..plans.frame import Frame, LakemillError, Series


class PrimaryKeyError(LakemillError):
    pass


#: Cells of one uploaded chunk.
CHUNK_CELLS = 100_000


def checked(table: str) -> str:
    if not isinstance(table, str) or not re.fullmatch(r"\w+(\.\w+)?", table, re.ASCII):
        raise ValueError(f"not a table name: {table!r}")
    return table


def spark_type(series) -> T.DataType:
    """The column type for a Pandas series: two-valued ones are small integers, whole numbers take the smallest fitting of int and bigint."""
    import pandas as pd

    kind = series.dtype
    if kind == object or str(kind) in ("bool", "boolean", "str", "string"):
        if all(v in (0, 1) and not isinstance(v, str) for v in series.dropna().unique()) and len(series.dropna()):
            return T.ShortType()
        return T.StringType()
    if pd.api.types.is_datetime64_any_dtype(kind):
        return T.TimestampType()
    if pd.api.types.is_integer_dtype(kind):
        return T.IntegerType() if not len(series) or abs(series).max() < 2147483647 / 2 else T.LongType()
    return T.DoubleType()


class Database:
    """A catalog's current schema. models: the table that lists models."""

    def __init__(self, spark: SparkSession, models: str = "lakemill_models") -> None:
        self.spark, self.models = spark, checked(models)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """The session stays: others may use it."""

    commit = rollback = close

    def reconnect(self) -> None:
        """Go on with the running session, or with a new one of the same settings if it has ended."""
        if self.spark.sparkContext._jsc is None or self.spark.sparkContext._jsc.sc().isStopped():
            self.spark = SparkSession.builder.getOrCreate()

    # Catalog

    @property
    def current_schema(self) -> str:
        return self.spark.catalog.currentDatabase()

    def show_tables(self, show_all: bool = False) -> DataFrame:
        """TABSCHEMA, TABNAME, OWNER, TYPE (T or V) of the current schema, or of all."""
        schemas = [d.name for d in self.spark.catalog.listDatabases()] if show_all else [self.current_schema]
        rows = [(s, t.name, None, "V" if t.tableType in ("VIEW", "TEMPORARY") else "T") for s in schemas for t in self.spark.catalog.listTables(s)]
        return self.spark.createDataFrame(sorted(set(rows), key=str), "TABSCHEMA string, TABNAME string, OWNER string, TYPE string")

    def _kind(self, table: str) -> str | None:
        try:
            t = self.spark.catalog.getTable(checked(table))
        except AnalysisException:
            return None
        return "view" if t.tableType in ("VIEW", "TEMPORARY") else "table"

    def exists_table_or_view(self, table: str) -> bool:
        return self._kind(table) is not None

    def exists_table(self, table: str) -> bool:
        return self._exists(table, "table")

    def exists_view(self, table: str) -> bool:
        return self._exists(table, "view")

    def _exists(self, table: str, kind: str) -> bool:
        """False if nothing has the name; TypeError if something of another kind has."""
        found = self._kind(table)
        if found not in (None, kind):
            raise TypeError(f"{table} is a {found}")
        return found == kind

    def is_table_or_view(self, table: str) -> bool:
        return self._is(table, ("table", "view"))

    def is_table(self, table: str) -> bool:
        return self._is(table, ("table",))

    def is_view(self, table: str) -> bool:
        return self._is(table, ("view",))

    def _is(self, table: str, kinds: tuple[str, ...]) -> bool:
        """ValueError if nothing has the name."""
        found = self._kind(table)
        if found is None:
            raise ValueError(f"{table} does not exist")
        return found in kinds

    def _need(self, table: str, kind: str) -> None:
        if not self._is(table, (kind,)):
            raise TypeError(f"{table} is not a {kind}")

    # Reading and SQL

    def frame(self, table: str, index: str | None = None) -> Frame:
        if self._kind(table) is None:
            raise NameError(f"{table} does not exist")
        out = Frame(self.spark.table(table), index=index)
        out.database, out.table = self, table
        return out

    def get_primary_key(self, table: str) -> str | None:
        """The key that upload() was given, from the table's properties."""
        self._need(table, "table")
        return self._properties(table).get("lakemill.primary_key")

    def _properties(self, table: str) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {checked(table)}").collect()}  # a few settings

    def analyze(self, table: str, buckets: int = 254) -> None:
        """Let the catalog keep statistics of the table and all its columns, with histograms."""
        self._need(table, "table")
        was = {k: self.spark.conf.get(k) for k in ("spark.sql.statistics.histogram.enabled", "spark.sql.statistics.histogram.numBins")}
        try:
            self.spark.conf.set("spark.sql.statistics.histogram.enabled", "true")
            self.spark.conf.set("spark.sql.statistics.histogram.numBins", str(buckets))
            self.spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)

    def entropy_stats(self, table: str, columns: list[str] | None = None, mode: str = "normal") -> DataFrame:
        """column, entropy: from the catalog's statistics alone, without reading the table (analyze() makes them).

        An approximation from above: the values of a histogram's bin, or of a column without one, count as equally frequent. Columns without
        statistics have a null.
        """
        if mode not in ("normal", "raw"):
            raise ValueError("mode must be 'normal' or 'raw'")
        self._need(table, "table")
        about = self.spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Statistics'").first()
        rows = int((about and re.search(r"(\d+) rows", about["data_type"]) or "00")[1])
        out = []
        for c in columns or self.spark.table(table).columns:
            kept = {r["info_name"]: r["info_value"] for r in self.spark.sql(f"DESCRIBE EXTENDED {table} `{c}`").collect()}
            distinct, nulls = kept.get("distinct_count"), kept.get("num_nulls")
            if distinct in (None, "NULL") or not rows:
                out.append((c, None))
                continue
            n = rows - int(nulls)
            text = "\n".join(f"{k} {v}" for k, v in kept.items())
            height = re.search(r"height: ([0-9.Ee+-]+)", text)
            sizes: dict[tuple, float] = {}
            for k, (low, high, d) in enumerate(re.findall(r"lower_bound: (\S+), upper_bound: (\S+), distinct_count: (\d+)", text)):
                # A value that fills several bins is one value.
                key = (low,) if low == high else (low, high, k, max(int(d), 1))
                sizes[key] = sizes.get(key, 0.0) + float(height[1])
            groups = [(m / k[3], k[3]) if len(k) > 1 else (m, 1) for k, m in sizes.items()] or [(n / max(int(distinct), 1), int(distinct))]
            raw = -sum(many * a * math.log(a) for a, many in groups if a > 0)
            out.append((c, raw if mode == "raw" else (raw / n + math.log(n)) / math.log(2) if n else 0.0))
        return self.spark.createDataFrame(out, "column string, entropy double")

    def query(self, sql: str, first_row_only: bool = False):
        """A frame, a series for one column, or the first row as a tuple."""
        df = self.spark.sql(sql)
        if first_row_only:
            row = df.first()
            return None if row is None else tuple(row)
        out = Frame(df)
        return out[df.columns[0]] if len(df.columns) == 1 else out

    def scalar_query(self, sql: str):
        row = self.spark.sql(sql).first()
        return None if row is None else row[0]

    def read_csv(self, path: str, schema: str | T.StructType, header: bool = True, sep: str = ",") -> Frame:
        return Frame(self.spark.read.csv(path, schema=schema, header=header, sep=sep))

    def read_jdbc(self, url: str, table: str, **options: str) -> Frame:
        return Frame(self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())

    # Writing

    def upload(self, pdf, table: str, clear_existing: bool = False, primary_key: str | None = None, index: str | None = None) -> Frame:
        """A Pandas DataFrame as a table. The key must be unique and not null."""
        if primary_key is not None and (pdf[primary_key].isna().any() or pdf[primary_key].duplicated().any()):
            raise PrimaryKeyError(f"{primary_key} is not unique")
        self._free(table, clear_existing)
        self._from_pandas(pdf).write.saveAsTable(checked(table))
        if primary_key is not None:
            key = primary_key.replace("'", "\\'")
            self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('lakemill.primary_key' = '{key}')")
        return self.frame(table, index or primary_key)

    def _from_pandas(self, pdf, schema: T.StructType | None = None) -> DataFrame:
        schema = schema or T.StructType([T.StructField(str(c), spark_type(pdf[c])) for c in pdf.columns])
        whole = {T.ShortType: int, T.IntegerType: int, T.LongType: int, T.DoubleType: float, T.StringType: str}
        cast = [whole.get(type(f.dataType), lambda v: v) for f in schema]
        rows = [tuple(None if v is None or v != v else f(v) for f, v in zip(cast, r, strict=True)) for r in pdf.itertuples(index=False, name=None)]
        return self.spark.createDataFrame(rows, schema)

    def append(self, frame: Frame, pdf, maxnrow: int | None = None) -> Frame:
        """Add rows, in chunks, to the table under a frame. Columns must have the same names in the same order."""
        table = getattr(frame, "table", frame if isinstance(frame, str) else None)
        if table is None:
            raise ValueError("append needs a table's name")
        schema = self.spark.table(checked(table)).schema
        if list(pdf.columns) != schema.names:
            raise ValueError("the columns differ in name or order")
        n = maxnrow or max(1, CHUNK_CELLS // max(1, len(schema)))
        for a in range(0, len(pdf), n):
            self._from_pandas(pdf.iloc[a : a + n], schema).write.mode("append").insertInto(table)
        return self.frame(table)

    def save_as(self, frame: Frame, table: str, clear_existing: bool = False) -> Frame:
        """The frame as a table. A table that the frame itself reads is replaced by way of another one."""
        staged = f"{checked(table)}_{uuid.uuid4().hex[:8]}"
        if self._kind(table) is not None and not clear_existing:
            raise NameError(f"{table} exists")
        frame.spark().write.saveAsTable(staged)
        self._free(table, clear_existing)
        self.spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
        return self.frame(table)

    def _free(self, table: str, clear_existing: bool) -> None:
        kind = self._kind(table)
        if kind is not None:
            if not clear_existing:
                raise NameError(f"{table} exists")
            self.spark.sql(f"DROP {kind.upper()} {table}")

    def create_view(self, frame: Frame, view: str) -> Frame:
        frame.spark().createOrReplaceTempView(checked(view))
        return self.frame(view)

    def drop_table(self, table: str) -> None:
        self._need(table, "table")
        self.spark.sql(f"DROP TABLE {table}")

    def drop_view(self, view: str) -> None:
        self._need(view, "view")
        self.spark.sql(f"DROP VIEW {view}")

    def rename(self, table: str, new: str) -> Frame:
        self._need(table, "table")
        if table == checked(new):
            raise NameError("the names are the same")
        self.spark.sql(f"ALTER TABLE {table} RENAME TO {new}")
        return self.frame(new)

    def add_column_id(self, table: str, column_id: str = "ID", destructive: bool = False) -> Frame:
        out = self.frame(table).add_column_id(column_id)
        return self.save_as(out, table, clear_existing=True) if destructive else out

    def add_column(self, frame: Frame, column: str | None = None, colname: str | None = None, ncat: int = 10, seed: int = 0) -> Frame:
        """Copy a column, or add random whole numbers from 1 to ncat."""
        new = colname or next(f"COL{k}" for k in range(len(frame.cols) + 1) if f"COL{k}" not in frame.cols)
        e = name(column) if column else F.floor(F.rand(seed) * ncat + 1).cast("int")
        return Frame(frame.df.withColumn(new, e))

    def delete_column(self, table: str, column: str, destructive: bool = False) -> Frame:
        out = self.frame(table)
        del out[column]
        return self.save_as(out, table, clear_existing=True) if destructive else out

    # Models: sets of tables <MODEL>_<PART>

    def show_models(self) -> DataFrame:
        schema = "MODEL string, KIND string, TABNAME string"
        return self.spark.table(self.models) if self._kind(self.models) else self.spark.createDataFrame([], schema)

    def save_model(self, model: str, kind: str, parts: dict[str, DataFrame]) -> None:
        checked(model)
        for part, df in parts.items():
            df.write.mode("overwrite").saveAsTable(f"{model}_{part}")
        rows = [(model, kind, f"{model}_{part}") for part in parts]
        self.spark.createDataFrame(rows, "MODEL string, KIND string, TABNAME string").write.mode("append").saveAsTable(self.models)

    def exists_model(self, model: str) -> bool:
        return bool(self.show_models().where(F.col("MODEL") == checked(model)).take(1))

    def is_model(self, model: str) -> bool:
        if not self.exists_model(model):
            raise ValueError(f"{model} is no model")
        return True

    def drop_model(self, model: str) -> None:
        self.is_model(model)
        models = self.show_models()
        for r in models.where(F.col("MODEL") == model).collect():  # the parts of one model
            self.spark.sql(f"DROP TABLE IF EXISTS {r['TABNAME']}")
        rest = [tuple(r) for r in models.where(F.col("MODEL") != model).collect()]  # a row a model part
        self.spark.createDataFrame(rest, models.schema).write.mode("overwrite").saveAsTable(f"{self.models}_new")
        self.spark.sql(f"DROP TABLE {self.models}")
        self.spark.sql(f"ALTER TABLE {self.models}_new RENAME TO {self.models}")


__all__ = ["Database", "Frame", "PrimaryKeyError", "Series", "checked", "spark_type"]
