"""Document fingerprints by spot signatures.

Words are runs of letters and digits, lower-cased. After each anchor (a common word) the next CHAIN content words, with
anchors between them skipped, form a chain; anchor and chain hash to a signature of 8 hex digits. A fingerprint is the set
of a text's signatures, written as one sorted string, so equal texts have equal fingerprints and the likeness of two texts (the
Jaccard similarity of their sets) follows from the fingerprints alone. DataFrame functions only.

A text without anchors takes the chains of all its words; one without words takes the hash of the text itself; the
empty text (and null) has the empty fingerprint. Two empty fingerprints have likeness 1, an empty and another one 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Frequent function words of four languages.
ANCHORS = tuple(
    sorted(
        {
            *"the of and to a in is that it for was on with as be by this are at from".split(),
            *"de la le et les des en un du une que est pour qui dans par sur au pas avec".split(),
            *"de la que el en y los se del las un por con no una su para es al lo".split(),
            *"der die und in den von zu das mit sich des für auf im ist nicht dem ein eine als".split(),
        }
    )
)
CHAIN = 2
HEX = 8


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate value once for all its uses in an expression."""
    return F.transform(F.array(value), use)[0]


def _hash(s: Column) -> Column:
    return F.substring(F.md5(s.cast("binary")), 1, HEX)


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The sorted set of signatures of a text that is not null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # 'of the house and' becomes 'of_the_house and_': each item is a content word after the anchors before it.
    items = F.split(F.array_join(F.transform(words, lambda w: F.when(w.isin(*anchors), F.concat(w, F.lit("_"))).otherwise(F.concat(w, F.lit(" ")))), ""), " ")
    items = F.filter(items, lambda x: (x != "") & ~x.endswith("_"))

    def spots(t: Column) -> Column:
        return _let(F.transform(t, lambda x: F.substring_index(x, "_", -1)), lambda c: _chains(t, c))

    def _chains(t: Column, c: Column) -> Column:
        chain = c
        for k in range(1, CHAIN):
            later = F.concat(F.slice(c, k + 1, F.size(c)), F.array_repeat(F.lit(""), F.least(F.lit(k), F.size(c))))
            chain = F.zip_with(chain, later, lambda a, b: F.concat_ws(" ", a, b))
        spot = F.zip_with(t, chain, lambda x, y: _let(F.split(x, "_"), lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda a: _hash(F.concat_ws(" ", a, y)))))
        return _let(F.flatten(spot), lambda s: F.when(F.size(s) > 0, s).otherwise(F.transform(chain, lambda y: _hash(F.concat(F.lit(" "), y)))))

    found = _let(items, spots)
    whole = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(_hash(text)))
    return _let(found, lambda s: F.array_sort(F.array_distinct(F.when(F.size(s) > 0, s).otherwise(whole))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return _let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def following(docs: DataFrame, id_col: str, need: Column) -> DataFrame:
    """Each distinct id of docs with the next larger one, the last with the first: id, next_id, need (the largest of the id's rows).

    Ids are dealt in ranges and numbered by range, so no task sorts them all; what crosses ranges is one row a range. Null is the
    smallest id.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), need.alias("need")).groupBy("id").agg(F.max("need").alias("need"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "id-ranges")
    firsts = dealt.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull(), F.col("id"))).alias("first"))
    up = W.orderBy("part")
    edge = firsts.select("part", F.coalesce(F.lead("first").over(up), F.first("first").over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))["id"].alias("edge"))
    inside = W.partitionBy("part").orderBy("id")
    last = F.row_number().over(W.partitionBy("part").orderBy(F.desc("id"))) == 1
    return dealt.withColumns({"lead": F.lead("id").over(inside), "last": last}).join(edge, "part").select("id", F.when(F.col("last"), F.col("edge")).otherwise(F.col("lead")).alias("next_id"), "need")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited forms: id, n_chars, edited, signatures, edited_signatures, near_edited, near_next.

    A text's edited form has its last floor(n/4) code points replaced by as many of the next document's first ones (all, if it has
    fewer). Documents follow by id, the first after the last. Null texts are empty. Rows with equal ids (null is one) share their next document;
    of several rows with that id the one with the smallest beginning, then the smallest signatures, is taken. A table of one id is
    its own next document. Texts cross the network once by id; beginnings and signatures once more.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    order = cut(following(rows, "id", quarter), "next-ids")
    # Null ids join as a value of their own, on plain columns: the joins and the aggregation then share one partitioning.
    key = lambda c, k: [F.coalesce(F.col(c), F.lit(0)).alias(k), F.col(c).isNull().alias(f"{k}_null")]
    keyed = rows.select(*key("id", "k"), "text")
    asked = order.select(*key("next_id", "k"), *key("id", "b"), "need")
    here = keyed.join(asked.hint("merge"), ["k", "k_null"])
    heads = here.select("b", "b_null", F.struct(F.expr("left(text, need)").alias("head"), signatures(F.col("text")).alias("sigs")).alias("next")).groupBy("b", "b_null").agg(F.min("next").alias("next"))
    both = keyed.join(heads.select(F.col("b").alias("k"), F.col("b_null").alias("k_null"), "next").hint("merge"), ["k", "k_null"])
    n = F.char_length("text").cast("long")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.expr("left(next.head, cast(floor(char_length(text) / 4) as int))"))
    t = both.select(F.when(~F.col("k_null"), F.col("k")).alias(id_col), n.alias("n_chars"), edited.alias("edited"), signatures(F.col("text")).alias("signatures"), F.col("next.sigs").alias("next_signatures"))
    t = t.withColumn("edited_signatures", signatures(F.col("edited")))
    return t.select(id_col, "n_chars", "edited", "signatures", "edited_signatures", likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"))


def near_pairs(docs: DataFrame, least: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Near-duplicate pairs of fingerprints, from a likeness of `least` hundredths on, and membership: (a, b, likeness) between class
    representatives, (id, representative).

    Documents with equal fingerprints are one class, whose smallest id represents it; empty fingerprints pair with nothing. Sets are
    partitioned by length, in steps of the factor 100/least: a set meets only its own partition and the next. Within them
    candidates share one of the rarest signatures that likeness `least` makes them share, and are dropped by length before
    their intersection is counted. Rows with a null id are in no class.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), signatures(F.coalesce(F.col(text_col), F.lit(""))).alias("sigs"))
    named = cut(rows.withColumn("fp", F.md5(F.array_join("sigs", ""))), "fingerprints")
    classes = named.groupBy("fp").agg(F.min("id").alias("representative"))
    members = named.select("id", "fp").join(classes, "fp").select("id", "representative")
    one = cut(named.join(classes, "fp").where("id = representative and size(sigs) > 0").select("id", "sigs", F.size("sigs").alias("n")).dropDuplicates(["id"]), "fingerprint-classes")
    flat = one.select("id", "n", F.explode("sigs").alias("sig"))
    common = flat.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    # Only signatures that two sets hold can pair them; a set with too few of those is out.
    ranked = flat.join(common, "sig").withColumns({"at": F.row_number().over(W.partitionBy("id").orderBy("df", "sig")), "shared": F.count("*").over(W.partitionBy("id"))})
    rare = ranked.where(F.col("at") <= F.col("shared") - F.expr(f"(n * {least} + 99) div 100") + 1).withColumn("step", F.floor(F.log("n") / F.log(F.lit(100 / least))))
    a = rare.select("sig", "step", F.col("id").alias("a"), F.col("n").alias("na"))
    b = rare.select("sig", F.explode(F.array(F.col("step"), F.col("step") - 1)).alias("step"), F.col("id").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["sig", "step"]).where((F.col("a") != F.col("b")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") * 100 >= F.col("nb") * least)).select("a", "b").distinct()
    sets = lambda k: one.select(F.col("id").alias(k), F.col("sigs").alias(f"s{k}"))
    pairs = met.join(sets("a"), "a").join(sets("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb"))).where(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * least)
    pairs = pairs.withColumn("likeness", F.col("both") / (F.size("sa") + F.size("sb") - F.col("both")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members
