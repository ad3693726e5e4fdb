"""Tables written to the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir, with a local master.
DEFAULT = "file:///tmp/checkpoints"

_written: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, read back. Without spark.checkpoint.dir only a local master can go on."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(named or DEFAULT).rstrip('/')}/lakemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this process has written: for callers that are done with every result."""
    for path in sorted(_written):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.clear()


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, for work that is long a row: a file of few row groups is read by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """df with a long column `name`: each row's place in the order, from `start`.

    Rows are dealt in ranges of the order and numbered within each; only one count a range meets in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    base = sums.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    at = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__at", at).join(base, "__part").withColumn(name, F.col("__base") + F.col("__at") - 1 + start).drop("__part", "__at", "__base")


def prefix_sums(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over all rows with a smaller `order`, which is unique."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "sums")
    base = dealt.groupBy("__part").agg(F.sum(value).alias("__s")).select("__part", F.coalesce(F.sum("__s").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    before = F.coalesce(F.sum(value).over(W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__before", before).join(base, "__part").withColumn(out, F.col("__before") + F.col("__base")).drop("__part", "__before", "__base")


#: Running aggregates: how rows are taken together, and how what came before joins what came since.
_RUNNING = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least), "prod": (F.product, lambda a, b: a * b)}


def running(df: DataFrame, order: list[Column], out: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column for each of out: (kind, value), the value's sum, max, min, prod or mean over the rows up to its own in the order.

    Nulls are passed over; where no value has come yet the result is null. Rows are dealt in ranges of the order, and only one row of
    aggregates a range meets in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made, last = {}, {}
    for k, (c, (kind, value)) in enumerate(out.items()):
        made[f"__v{k}"], last[c] = ("sum" if kind == "mean" else kind, value), F.col(f"__v{k}")
        if kind == "mean":
            made[f"__n{k}"], last[c] = ("sum", value.isNotNull().cast("long")), F.try_divide(F.col(f"__v{k}"), F.col(f"__n{k}"))
    dealt = written(df.withColumns({v: value for v, (_, value) in made.items()}).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "running")
    before, upto = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    of = {v: _RUNNING[kind] for v, (kind, _) in made.items()}
    base = dealt.groupBy("__part").agg(*[take(v).alias(v) for v, (take, _) in of.items()]).select("__part", *[take(v).over(before).alias(f"{v}b") for v, (take, _) in of.items()])
    own = dealt.withColumns({v: take(v).over(upto) for v, (take, _) in of.items()}).join(base, "__part")
    met = own.withColumns({v: F.coalesce(join(F.col(f"{v}b"), F.col(v)), F.col(v), F.col(f"{v}b")) for v, (_, join) in of.items()})
    return met.withColumns(last).drop("__part", *made, *[f"{v}b" for v in made])
