"""Shared pieces of the corpus operators: cut points in the shared folder and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no spark.checkpoint.dir, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints"

#: A word, as the shingle operators and the mixing budget count them.
WORD = r"[^\x20\x09-\x0D]+"

#: Folders written by this process that are still there.
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without spark.checkpoint.dir only a local master can go on."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or DEFAULT_SHARED).rstrip('/')}/lakemill"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def uncut(*frames: DataFrame) -> None:
    """Remove cut tables that nothing reads any more."""
    for df in frames:
        if path := vars(df).get("written_to"):
            remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables and token files that this process has written: for callers that are done with every result."""
    for path in sorted(_written):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    _written.discard(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage, for loops of many small jobs.

    Each small table that a join broadcasts leaves megabytes of short-lived arrays on the driver, and the heap grows to its limit before it is cleared. What
    Spark keeps for tables that nothing refers to any more (broadcasts, shuffle files) goes with it.
    """
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filtered(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run), whose batches keep their columns. Columns go by place, so their names may be any, dots included."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def fold(column: str, k: int) -> Column:
    """crc32 of an id as text, modulo k: the held-out folds. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def row_parts(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for so many rows: as many as the session shuffles into, more if one would hold over per_part rows."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows), -(-rows // per_part))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (u, v: long) -> (node, component = smallest node).

    Each round every node points to the neighbour with the smallest seeded hash (itself included) and edges are
    carried over to the nodes pointed to, so every component loses a constant share of its nodes a round, chains
    and stars alike. Aggregates are partial before each shuffle and joins meet a table with one row a node, so a node
    with very many neighbours is no group that one task must hold. Nothing but row counts reaches the driver.
    Null ends and loops are ignored; repeated edges count once.
    """
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    live = cut(e.where("u is not null and v is not null and u <> v").distinct(), "edges")
    hops: list[DataFrame] = []
    spark = edges.sparkSession
    while not is_empty(live):
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(hops))).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        ends = live.select("u", "v").union(live.select("v", "u")).toDF("node", "other")
        hop = cut(ends.groupBy("node").agg(F.min(rank("other")).alias("m")).select("node", F.least("m", rank("node"))["n"].alias("up")), "hop")
        to = lambda c: hop.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        moved = live.join(to("u"), "u").join(to("v"), "v").where("u_up <> v_up")
        after = cut(moved.select(F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v")).distinct(), "edges")
        uncut(live)
        live = after
        hops.append(hop)
        tidy(spark)
    if not hops:
        return spark.createDataFrame([], T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType())]))
    at = hops[0]
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("up"), F.col("up").alias("next"))
        at = at.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
    at = cut(at, "roots")
    least = at.groupBy("up").agg(F.min(F.least("node", "up")).alias("component"))
    out = cut(at.join(least, "up").select("node", "component"), "components")
    uncut(at, live, *hops)
    return out
