"""Mixing sources to target weights: hierarchical budgets over a domain - language - source tree.

A token budget is divided from the root down. At each node the children's shares follow their weights; a child whose
whole subtree holds less than its share (times the epochs allowed) gives up the rest, which its siblings divide among
themselves by their weights again before anything is left to the node's own siblings. Each leaf then takes that many tokens from its
documents in the order of a seeded hash, epoch after epoch, each epoch in an order of its own.

DataFrame functions only. Running sums are two-level (a leaf's hash buckets, then the one bucket in which the budget ends),
so no task gathers a leaf, and texts are not shuffled: a leaf's selection is a cut in hash order.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

#: Leaves whose budgets are broadcast, at most; more are joined.
BROADCAST_LEAVES = 10_000
#: What stands for a null language or source in the tree.
NONE = ""


@dataclass(frozen=True)
class Tree:
    """Weights are whole numbers; what is not listed has weight `other`. A source's domain is that of the first prefix that fits."""

    domains: Mapping[str, int]
    languages: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    domain_of: tuple[tuple[str, str], ...] = ()
    other_domain: str = "other"
    other: int = 1


def _weight(of: Mapping[str, int], column: str, other: int) -> Column:
    out = F.lit(other)
    for k, v in sorted(of.items()):
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out.cast("decimal(38,0)")


def n_tokens(text: str) -> Column:
    """Tokens of a text as the budget counts them: its words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def leaf_columns(tree: Tree, lang: str = "lang", source: str = "source") -> dict[str, Column]:
    src = F.coalesce(F.col(source).cast("string"), F.lit(NONE))
    domain = F.lit(tree.other_domain)
    for prefix, name in reversed(tree.domain_of):
        domain = F.when(src.startswith(prefix), F.lit(name)).otherwise(domain)
    return {"__domain": domain, "__lang": F.coalesce(F.col(lang).cast("string"), F.lit(NONE)), "__source": src}


def divide(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes (parent columns, child, cap, weight, amount: what the parent got) with `got`: the child's budget.

    Sorted by capacity over weight, the children that fill up are a prefix; the others divide the rest by weight, and
    the units that rounding leaves go one each in the order of their names. Whole numbers throughout. Weight 0 gets nothing.
    """
    by = W.partitionBy(*parent).orderBy(F.expr("cap / weight"), child)
    before, all_ = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*parent)
    t = nodes.where("weight > 0").withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    big = lambda a, b: f"cast({a} as decimal(20,0)) * cast({b} as decimal(18,0))"
    t = t.withColumn("full", F.expr(f"{big('cap', 'w_left')} <= {big('amount - cap_before', 'weight')}"))
    t = t.withColumns({"rest": F.col("amount") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0)), "w_rest": F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_)})
    t = t.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.expr(f"({big('rest', 'weight')}) div cast(w_rest as decimal(18,0))")))
    t = t.withColumn("over", F.col("rest") - F.sum(F.when(~F.col("full"), F.col("got"))).over(all_))
    turn = F.row_number().over(W.partitionBy(*parent, "full").orderBy(child))
    t = t.withColumn("got", F.when(~F.col("full") & (turn <= F.col("over")), F.col("got") + 1).otherwise(F.col("got")))
    return t.drop("cap_before", "w_left", "full", "rest", "w_rest", "over")


@dataclass(frozen=True)
class Plan:
    """Leaf budgets and cuts. leaves: domain, lang, source, tokens, got, epochs (whole ones), rest, cut_key, cut_before."""

    leaves: DataFrame
    keys: DataFrame
    seed: int
    few: bool


LEAF = ["__domain", "__lang", "__source"]


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit(""))))


def plan(docs: DataFrame, tree: Tree, share: float, epochs: int, seed: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> Plan:
    """Budgets for `share` of all tokens, each leaf in at most `epochs` passes.

    Null texts and empty ones have no tokens; a leaf without tokens gets no budget and none of its documents. Null languages and
    sources are a language and a source of their own, the empty text. Rows that repeat an id have one place in the order
    and are taken together. An empty table gives an empty plan. Other columns of docs are not read.
    """
    own = leaf_columns(tree, lang_col, source_col)
    keys = cut(docs.select(F.col(id_col).cast("long").alias("__id"), *[c.alias(k) for k, c in own.items()], n_tokens(text_col).alias("__n")), "mix-keys")
    leaves = cut(keys.groupBy(*LEAF).agg(F.sum("__n").alias("tokens"), F.count("*").alias("docs")).withColumn("cap", F.col("tokens") * epochs), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    weighed = lambda df, of, c: df.withColumn("weight", _weight(of, c, tree.other))
    top = weighed(leaves.groupBy("__domain").agg(F.sum("cap").alias("cap")), tree.domains, "__domain").withColumns({"amount": F.least(F.lit(int(total[0] * share)), F.lit(total[0] * epochs)), "__root": F.lit(0)})
    top = divide(top, ["__root"], "__domain").select("__domain", F.col("got").alias("amount"))
    mid = weighed(leaves.groupBy("__domain", "__lang").agg(F.sum("cap").alias("cap")), tree.languages, "__lang").join(top, "__domain")
    mid = divide(mid, ["__domain"], "__lang").select("__domain", "__lang", F.col("got").alias("amount"))
    low = divide(weighed(leaves, tree.sources, "__source").join(mid, ["__domain", "__lang"]), ["__domain", "__lang"], "__source")
    got = cut(low.where("tokens > 0").select(*LEAF, "tokens", "docs", "got").withColumns({"epochs": F.expr("got div tokens"), "rest": F.expr("got % tokens")}), "mix-budgets")
    few = total[1] <= BROADCAST_LEAVES
    small = lambda df: F.broadcast(df) if few else df
    rows = keys.join(small(got.where("rest > 0").select(*LEAF, "epochs", "rest")), LEAF).withColumn("key", _key(seed, F.col("epochs"))).withColumn("part", F.substring("key", 1, 4))
    sums = rows.groupBy(*LEAF, "part").agg(F.sum("__n").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(W.partitionBy(*LEAF).orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    crossed = sums.withColumn("upto", upto).where("upto >= rest and upto - n < rest").select(*LEAF, "part", (F.col("upto") - F.col("n")).alias("before"))
    inside = rows.join(small(crossed), [*LEAF, "part"]).groupBy(*LEAF, "key", "rest", "before").agg(F.sum("__n").alias("n"))
    start = F.col("before") + F.coalesce(F.sum("n").over(W.partitionBy(*LEAF).orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = inside.withColumn("start", start).where("start < rest").groupBy(*LEAF).agg(F.max("key").alias("cut_key"), F.max("start").alias("cut_before"))
    return Plan(cut(got.join(cuts, LEAF, "left"), "mix-plan"), keys, seed, few)


def _taken(rows: DataFrame, p: Plan) -> DataFrame:
    """rows (LEAF, __id) that the plan takes, once for each epoch, with epoch, epochs, rest, key, cut_key, cut_before."""
    leaves = F.broadcast(p.leaves) if p.few else p.leaves
    t = rows.join(leaves, LEAF).withColumn("key", _key(p.seed, F.col("epochs")))
    copies = F.col("epochs") + F.coalesce(F.col("key") <= F.col("cut_key"), F.lit(False)).cast("int")
    return t.withColumn("__copies", copies).where("__copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))


def selection(p: Plan, id_col: str = "doc_id") -> DataFrame:
    """A row for each document and epoch taken: id, domain, lang, source, epoch, n_tokens, taken_tokens.

    taken_tokens is less than n_tokens only for the document in which a leaf's budget ends. (If that document is in several rows, each
    of them may give as much.)
    """
    t = _taken(p.keys, p)
    ends = (F.col("epoch") == F.col("epochs")) & (F.col("key") == F.col("cut_key"))
    taken = F.when(ends, F.least("__n", F.col("rest") - F.col("cut_before"))).otherwise(F.col("__n"))
    return t.select(F.col("__id").alias(id_col), F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), "epoch", F.col("__n").alias("n_tokens"), taken.alias("taken_tokens"))


def mixed(docs: DataFrame, p: Plan, tree: Tree, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that the plan takes, whole, once for each epoch; columns as in docs."""
    own = leaf_columns(tree, lang_col, source_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), *[c.alias(k) for k, c in own.items()])
    return _taken(rows, p).select("__row.*")
