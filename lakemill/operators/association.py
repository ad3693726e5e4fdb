"""Association rules over (transaction, item) tables, with heads of several items."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import written
from .estimator import Estimator
from .stats import name


class AssociationRules(Estimator):
    """minsupport: a share in (0, 1) or a count from 1; maxlen: items of a pattern; maxheadlen: items of a rule's head."""

    def __init__(self, modelname: str | None = None, minsupport: float | None = None, maxlen: int = 5, maxheadlen: int = 1, minconf: float = 0.5) -> None:
        if not 0 <= minconf <= 1:
            raise ValueError("minconf must be between 0 and 1")
        if minsupport is not None and minsupport <= 0:
            raise ValueError("minsupport must be positive")
        if maxlen < 2 or not 1 <= maxheadlen < maxlen:
            raise ValueError("maxlen must be 2 or more and maxheadlen less than it")
        self.modelname, self.minsupport, self.maxlen, self.maxheadlen, self.minconf = modelname, minsupport, maxlen, maxheadlen, minconf
        self.patterns = None

    def fit(self, df: DataFrame, transaction_id: str, item_id: str, names: DataFrame | None = None, namecol: str | None = None) -> AssociationRules:
        """names: a table that maps item_id to a name in namecol."""
        if missing := [c for c in (transaction_id, item_id) if c not in df.columns]:
            raise ValueError(f"no column {missing}")
        self.transaction_id, self.item_id, self.fitted = transaction_id, item_id, df
        rows = self._rows(df)
        if names is not None:
            rows = rows.join(names.select(name(item_id).cast("string").alias("item"), name(namecol).alias("label")), "item").select("tid", F.col("label").alias("item"))
        baskets = rows.groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items"))
        self.n = baskets.count()
        share = 0.1 if self.minsupport is None else self.minsupport if self.minsupport < 1 else self.minsupport / max(self.n, 1)
        schema = "items array<string>, freq long"
        spark = df.sparkSession
        found = FPGrowth(itemsCol="items", minSupport=min(share, 1.0)).fit(baskets).freqItemsets if self.n else spark.createDataFrame([], schema)
        self.patterns = written(found.where(F.size("items") <= self.maxlen).select(F.array_sort("items").alias("items"), "freq"), "patterns")
        self.rules = self._rules().withColumn("PRUNED", F.lit(False))
        return self

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(name(self.transaction_id).alias("tid"), name(self.item_id).cast("string").alias("item")).where("tid is not null and item is not null")

    def _rules(self) -> DataFrame:
        """Each pattern is divided into body and head in every way the head's length allows; counts are looked up among the patterns."""
        whole = self.patterns.where("size(items) > 1")
        # Subsets by number: bit k says whether item k is in the head.
        masks = F.expr("sequence(1, shiftleft(1, size(items)) - 2)")
        split = whole.select("items", "freq", F.explode(masks).alias("m"))
        has = lambda on: F.filter("items", lambda _, k: (F.floor(F.col("m") / F.pow(F.lit(2), k)) % 2 == on))
        parts = split.select("items", "freq", has(0).alias("body"), has(1).alias("head")).where(F.size("head") <= self.maxheadlen)
        of = lambda c, n: self.patterns.select(F.col("items").alias(c), F.col("freq").alias(n))
        joined = parts.join(of("body", "nb"), "body").join(of("head", "nh"), "head")
        n = F.lit(float(max(self.n, 1)))
        conf = F.col("freq") / F.col("nb")
        return joined.select("body", "head", (F.col("freq") / n).alias("support"), conf.alias("confidence"), (conf / (F.col("nh") / n)).alias("lift"), F.size("items").alias("length")).where(F.col("confidence") >= self.minconf)

    def prune(self, itemsin: Sequence[str] = (), itemsout: Sequence[str] = (), minlen: int = 1, maxlen: int | None = None, minsupport: float = 0, maxsupport: float = 1, minlift: float | None = None, maxlift: float | None = None, minconf: float | None = None, maxconf: float | None = None, reset: bool = False) -> AssociationRules:
        """Mark rules outside the limits as pruned. An item may end in :h (head) or :b (body). reset: unmark all first."""
        if self.patterns is None:
            raise ValueError("the model is not fitted")
        ok = F.col("length") >= minlen
        for value, column, low in ((maxlen, "length", False), (minsupport, "support", True), (maxsupport, "support", False), (minlift, "lift", True), (maxlift, "lift", False), (minconf, "confidence", True), (maxconf, "confidence", False)):
            if value is not None:
                ok &= F.col(column) >= value if low else F.col(column) <= value

        def in_rule(item: str):
            base, _, side = item.rpartition(":") if re.search(r":(h|head|b|body)$", item) else (item, "", "")
            at = {"h": [F.col("head")], "b": [F.col("body")]}.get(side[:1], [F.col("body"), F.col("head")])
            return F.array_contains(F.concat(*at), base)

        if itemsin:
            any_ = F.lit(False)
            for i in itemsin:
                any_ |= in_rule(i)
            ok &= any_
        for i in itemsout:
            ok &= ~in_rule(i)
        before = F.lit(False) if reset else F.col("PRUNED")
        self.rules = self.rules.withColumn("PRUNED", before | ~ok)
        return self

    def predict(self, df: DataFrame, transaction_id: str | None = None, item_id: str | None = None, type: str = "rules", limit: int = 1, sort: str | None = None) -> DataFrame:
        """The best `limit` rules (or patterns) of each transaction that has all items of the body (or pattern).

        A rule is found through one of its items: an inverted index from item to rule, then a count of its items that the transaction has.
        """
        if self.patterns is None:
            raise ValueError("the model is not fitted")
        if type not in ("rules", "patterns"):
            raise ValueError("type must be 'rules' or 'patterns'")
        self.transaction_id, self.item_id = transaction_id or self.transaction_id, item_id or self.item_id
        if type == "rules":
            cand = self.rules.where(~F.col("PRUNED")).withColumns({"need": F.col("body"), "key": F.to_json(F.struct("body", "head")), "text": F.concat_ws("|", F.array_join("body", ","), F.array_join("head", ","))})
            keys = sort or "support;confidence;length"
        else:
            cand = self._pattern_lift().withColumns({"need": F.col("items"), "key": F.to_json(F.struct("items")), "text": F.array_join("items", ",")})
            keys = sort or "support;lift;length"
        order = [F.desc(k) for k in keys.split(";")]
        rows = self._rows(df).distinct()
        index = cand.select("key", F.size("need").alias("k"), F.explode("need").alias("item"))
        hits = rows.join(index, "item").groupBy("tid", "key", "k").agg(F.count("*").alias("c")).where("c = k").select("tid", "key")
        best = hits.join(cand.drop("need"), "key").withColumn("rank", F.row_number().over(W.partitionBy("tid").orderBy(*order, "text", "key")))
        return best.where(F.col("rank") <= limit).drop("key", "text", "PRUNED")

    def _pattern_lift(self) -> DataFrame:
        n = float(max(self.n, 1))
        single = self.patterns.where("size(items) = 1").select(F.col("items")[0].alias("item"), F.col("freq").alias("f"))
        logs = self.patterns.select("items", "freq", F.explode("items").alias("item")).join(single, "item").groupBy("items", "freq").agg(F.sum(F.log(F.col("f") / n)).alias("l"))
        return logs.select("items", (F.col("freq") / n).alias("support"), F.exp(F.log(F.col("freq") / n) - F.col("l")).alias("lift"), F.size("items").alias("length"))

    def tables(self) -> dict[str, DataFrame]:
        p = self.patterns
        spark = self.fitted.sparkSession
        return {
            "ASSOCPATTERNS": p.select(F.array_join("items", ",").alias("ITEMSET"), F.size("items").alias("LENGTH"), F.col("freq").alias("COUNT"), (F.col("freq") / float(max(self.n, 1))).alias("SUPPORT")),
            "ASSOCPATTERNS_STATISTICS": p.groupBy(F.size("items").alias("LENGTH")).agg(F.count("*").alias("PATTERNS"), F.max("freq").alias("MAXCOUNT")),
            "ASSOCRULES": self.rules.select(F.array_join("body", ",").alias("BODY"), F.array_join("head", ",").alias("HEAD"), "support", "confidence", "lift", "length", "PRUNED"),
            "ITEMS": p.where("size(items) = 1").select(F.col("items")[0].alias("ITEM"), F.col("freq").alias("COUNT")),
            "MODEL": spark.createDataFrame([(self.modelname, self.n, float(self.minconf), self.maxlen)], "MODELNAME string, TRANSACTIONS long, MINCONF double, MAXLEN int"),
        }
