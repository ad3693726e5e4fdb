"""URL filters: path rules first, then association rules mined from labelled URLs.

A URL becomes a set of tokens: every host suffix, the words of its host, path segments (numbers as '#'), the file ending, query keys and
whether there is a fragment. Spark's FP-growth finds the frequent token combinations among blocked rows; a rule
'combination => blocked' stays if its confidence and support reach the thresholds and no shorter rule within it is as
confident. Rules match through an inverted index: each is met by the token that fewest rows have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, is_empty, uncut

#: Rules whose index is broadcast, at most; more are joined.
MAX_RULES = 10_000


@dataclass(frozen=True)
class PathRule:
    """host: it and all its subdomains; path: a prefix, without the first slash."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


@dataclass(frozen=True)
class TokenRule:
    tokens: tuple[str, ...]
    confidence: float
    support: float


def _rest(url: Column) -> Column:
    """What follows the first '://', null where there is none."""
    return F.when(F.instr(url, "://") > 0, F.expr("substring(`{0}`, instr(`{0}`, '://') + 3)".format("__url")))


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with __url, host and path added. Null urls and urls without '://' have an empty host and path."""
    url = F.col("__url")
    out = pages.withColumn("__url", F.col(url_col))
    rest = _rest(url)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    # Only A-Z change: other letters have no place in a host.
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return out.withColumns({"host": F.coalesce(low, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def path_rule(rules: list[PathRule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(f"/{r.path}")
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens() -> Column:
    """Distinct tokens of a parsed row."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split(F.col("host"), "[.-]"), lambda w: w != ""), lambda w: F.concat(F.lit("word:"), w))
    named = lambda s: F.regexp_replace(s, "[0-9]+", "#")
    segments = F.transform(F.filter(F.split(F.col("path"), "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path:"), named(s)))
    query = F.regexp_extract(F.coalesce("__url", F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key:"), F.substring_index(s, "=", 1)))
    ends = F.regexp_extract(F.col("path"), r"(\.[A-Za-z0-9]+)$", 1)
    ending = F.when(ends != "", F.array(F.concat(F.lit("ending:"), ends))).otherwise(F.array())
    mark = F.when(F.instr(F.coalesce("__url", F.lit("")), "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array())
    none = F.array().cast("array<string>")
    return F.when(F.col("host") == "", none).otherwise(F.array_distinct(F.concat(suffixes, parts, segments, keys, ending.cast("array<string>"), mark.cast("array<string>"))))


def mine_rules(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, least_rows: int = 20, url_col: str = "url", label_col: str = "blocked") -> DataFrame:
    """Rules from labelled URLs: tokens, confidence, support, rarest (the token that fewest rows have).

    support: the share of all labelled rows that a rule's tokens and the label 'blocked' are in, and least_rows their least number. Rows with a null url or label
    say nothing; no rows, no rules. Counts are over all labelled rows and all their tokens; no count of tokens, sets or rules is
    capped. What can't be in a longer rule of its own is taken out before FP-growth: a token that no allowed row has (nothing betters
    it), and of tokens that are in the same rows all but one, for which the others stand in again afterwards. So a long URL met again
    and again gives as many sets as tokens, not all their combinations.
    """
    rows = parsed(labelled.select(F.col(url_col).alias("u"), F.col(label_col).cast("int").alias("y")).where("u is not null and y is not null"), "u").select(F.array_sort(url_tokens()).alias("tokens"), "y").where("size(tokens) > 0")
    sets = cut(rows.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("y").alias("bad")).withColumn("row", F.xxhash64("tokens")), "url-sets")
    none = sets.select("tokens", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"), F.lit("").alias("rarest")).limit(0)
    total, bad = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(support * total, least_rows)
    if bad < least:
        return none
    # Tokens by the rows that they are in: equal counts and an equal sum of row hashes.
    held = sets.select("n", "bad", "row", F.explode("tokens").alias("t"))
    met = held.groupBy("t").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("row").cast("decimal(38,0)")).alias("same")).where(F.col("bad") >= least)
    tokens = cut(met.groupBy("n", "bad", "same").agg(F.min("t").alias("t"), F.sort_array(F.collect_list("t")).alias("all")), "url-tokens")
    conf = F.col("bad") / F.col("n")
    rules = tokens.where(conf >= confidence).select(F.explode("all").alias("t"), conf.alias("confidence"), (F.col("bad") / total).alias("support")).select(F.array("t").alias("tokens"), "confidence", "support", F.col("t").alias("rarest"))
    grow = tokens.where("bad < n").select("t", F.col("n").alias("m"), "all")
    blocked = held.where("bad > 0").join(grow.select("t"), "t").groupBy("row").agg(F.collect_list("t").alias("items"), F.max("bad").alias("bad"))
    blocked = cut(blocked.where("size(items) > 1").select("items", F.explode(F.sequence(F.lit(1).cast("long"), "bad"))).select("items"), "url-baskets")
    made = [tokens, blocked]
    baskets = blocked.count()
    if baskets >= least:
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / baskets), numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(blocked).freqItemsets
        found = cut(found.where("size(items) > 1").select(F.array_sort("items").alias("items"), F.col("freq").alias("bad")), "url-frequent-sets")
        # How many rows, allowed ones too, have a set: those of its rarest token are looked at.
        by = found.select("items", "bad", F.explode("items").alias("t")).join(grow, "t").groupBy("items", "bad").agg(F.min(F.struct("m", "t"))["t"].alias("t"), F.map_from_entries(F.collect_list(F.struct("t", "all"))).alias("all"))
        own = sets.select("tokens", "n", F.explode("tokens").alias("t"))
        counted = by.drop("all").join(own, "t").where(F.size(F.array_except("items", "tokens")) == 0).groupBy("items", "bad", "t").agg(F.sum("n").alias("n"))
        good = counted.where(conf >= confidence).join(by.select("items", "all"), "items")
        each = F.aggregate(F.transform("items", lambda t: F.col("all")[t]), F.array(F.array().cast("array<string>")), lambda acc, m: F.flatten(F.transform(acc, lambda a: F.transform(m, lambda x: F.concat(a, F.array(x))))))
        more = good.select(F.explode(each).alias("tokens"), conf.alias("confidence"), (F.col("bad") / total).alias("support"), F.array_position("items", F.col("t")).cast("int").alias("at"))
        rules = rules.unionByName(more.select(F.array_sort("tokens").alias("tokens"), "confidence", "support", F.element_at("tokens", F.col("at")).alias("rarest")))
        made.append(found)
    every = cut(rules, "url-rules")
    shorter = every.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"), F.col("rarest").alias("t"))
    within = every.select("tokens", "confidence", F.explode("tokens").alias("t")).join(shorter, "t").where((F.size("part") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0))
    out = cut(every.join(within.select("tokens").distinct(), "tokens", "left_anti"), "minimal-url-rules")
    uncut(*made, every, sets)
    return out


def mine(labelled: DataFrame, *args, **kwargs) -> list[TokenRule]:
    """mine_rules() as a list of all rules, for callers that know there are few."""
    return sorted((TokenRule(tuple(r["tokens"]), r["confidence"], r["support"]) for r in mine_rules(labelled, *args, **kwargs).collect()), key=lambda r: (len(r.tokens), r.tokens))


def _matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url -> token_rule: the most confident rule whose tokens it all has, then the best supported, then the shortest and first."""
    index = rules.select(F.col("rarest").alias("t"), F.col("tokens").alias("part"), F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("text")).alias("rank"))
    if len(index.take(MAX_RULES + 1)) <= MAX_RULES:
        index = F.broadcast(index)
    hits = urls.select("__url", url_tokens().alias("own")).withColumn("t", F.explode("own")).join(index, "t").where(F.size(F.array_except("part", "own")) == 0)
    return hits.groupBy("__url").agg(F.min("rank")["text"].alias("token_rule"))


def judge(pages: DataFrame, rules: list[PathRule], mined: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (the path rule's text or null), token_rule (a mined rule's tokens or null) and verdict.

    The longest fitting path rule decides; without one a matching token rule blocks, and all else is allowed. Extra columns
    of pages with these names are replaced. Rows are judged one by one, equal urls together. mined: the table of mine_rules().
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "token_rule", "verdict", "__url")]
    rows = parsed(pages.select(*[F.col(f"`{c}`") for c in names]), url_col).withColumn("__rule", path_rule(rules))
    if mined is None or is_empty(mined):
        rows = rows.withColumn("token_rule", F.lit(None).cast("string"))
    else:
        rows = rows.join(_matched(rows.select("__url", "host", "path").where("host <> ''").distinct(), mined), "__url", "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("token_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(*[F.col(f"`{c}`") for c in names], "host", "path", F.col("__rule.rule").alias("rule"), "token_rule", verdict.alias("verdict"))
