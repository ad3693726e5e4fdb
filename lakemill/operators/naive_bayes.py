"""Naive Bayes from counts. Numeric inputs are discretised; every table of the model is counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written
from .discretize import apply_cuts, cuts
from .estimator import Estimator
from .stats import categorical, name, numeric


#: Log-probabilities of a model that are sent to every task, at most; a larger model meets the rows by merge joins.
MAX_SENT = 1_000_000


def _by_class(df: DataFrame, values: Column, out: str) -> DataFrame:
    """ID, CLASS and the class's value."""
    pairs = F.zip_with("classes", values, lambda c, v: F.struct(c.alias("CLASS"), v.alias(out)))
    return df.select("ID", F.explode(pairs).alias("s")).select("ID", "s.*")


class NaiveBayes(Estimator):
    """disc: how numeric inputs are put into bins ('ew', 'ewn', 'ef', 'em')."""

    def __init__(self, modelname: str | None = None, disc: str = "ew", bins: int | None = None) -> None:
        self.modelname, self.disc, self.bins = modelname, disc, bins
        self.counts = None

    def _flat(self, df: DataFrame, keep: list) -> DataFrame:
        """keep, ATTRIBUTE, VAL: a row for each input that is not null."""
        d = apply_cuts(df, self.cuts)
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("ATTRIBUTE"), name(c).cast("string").alias("VAL")) for c in self.inputs])).alias("s")
        return d.select(*keep, cells).select("*", "s.*").drop("s").where("VAL is not null")

    def fit(self, df: DataFrame, target: str, column_id: str = "ID", incolumn: list[str] | None = None) -> NaiveBayes:
        if missing := [c for c in (target, column_id) if c not in df.columns]:
            raise ValueError(f"no column {missing}")
        self.target, self.column_id, self.fitted = target, column_id, df
        usable = {*numeric(df), *categorical(df)}
        self.inputs = [c for c in (incolumn or df.columns) if c not in (target, column_id) and c in usable]
        if not self.inputs:
            raise ValueError("no input column")
        own = [c for c in self.inputs if c in numeric(df)]
        self.cuts = cuts(df, own, self.disc, self.bins, target if self.disc == "em" else None) if own else {}
        rows = df.where(name(target).isNotNull())
        self.classes = rows.groupBy(name(target).cast("string").alias("CLASS")).agg(F.count("*").alias("CLASSCOUNT"))
        self.counts = self._flat(rows, [name(target).cast("string").alias("CLASS")]).groupBy("ATTRIBUTE", "VAL", "CLASS").agg(F.count("*").alias("CLASSVALCOUNT"))
        return self

    def tables(self) -> dict[str, DataFrame]:
        attr = self.counts.groupBy("ATTRIBUTE", "CLASS").agg(F.sum("CLASSVALCOUNT").alias("ATTRCLASSCOUNT"))
        total = self.counts.groupBy("ATTRIBUTE").agg(F.sum("CLASSVALCOUNT").alias("TOTALCOUNT"))
        model = self.counts.join(attr, ["ATTRIBUTE", "CLASS"]).join(self.classes, "CLASS").join(total, "ATTRIBUTE").select("ATTRIBUTE", "VAL", "CLASS", "CLASSVALCOUNT", "ATTRCLASSCOUNT", "CLASSCOUNT", "TOTALCOUNT")
        rows = [(c, float(b)) for c, bs in self.cuts.items() for b in bs]
        return {"MODEL": model, "DISCRANGES": self.fitted.sparkSession.createDataFrame(rows, "COLNAME string, BREAK double")}

    def _logs(self, df: DataFrame, column_id: str | None, mestimation: bool) -> DataFrame:
        """ID, classes and logs: the classes by name, and the log-probability of each.

        A row meets, input by input, the array of its value: rows are not multiplied by classes and dealt out again.
        """
        if self.counts is None:
            raise ValueError("the model is not fitted")
        arrays = lambda value: F.sort_array(F.collect_list(F.struct("CLASS", value.alias("v"))))
        counts, classes = written(self.counts, "bayes-counts"), written(self.classes, "bayes-classes")
        by = counts.groupBy("ATTRIBUTE", "CLASS").agg(F.sum("CLASSVALCOUNT").alias("N")).join(counts.groupBy("ATTRIBUTE").agg(F.count_distinct("VAL").alias("M")), "ATTRIBUTE")
        # Every value with every class, and a null for the values not seen; a class without a value of the attribute has no say on it.
        values = counts.select("ATTRIBUTE", "VAL").distinct().unionAll(counts.select("ATTRIBUTE", F.lit(None).cast("string").alias("VAL")).distinct())
        cells = values.crossJoin(classes.select("CLASS")).join(by, ["ATTRIBUTE", "CLASS"], "left").join(counts, ["ATTRIBUTE", "VAL", "CLASS"], "left")
        n = F.col("CLASSVALCOUNT")
        log = F.log((F.coalesce(n, F.lit(0)) + 1.0) / (F.col("N") + F.col("M"))) if mestimation else F.log(F.coalesce(n.cast("double"), F.lit(0.5)) / F.col("N"))
        model = written(cells.groupBy("ATTRIBUTE", "VAL").agg(arrays(F.coalesce(log, F.lit(0.0)))["v"].alias("L")), "bayes-model")
        few = (model.agg(F.sum(F.size("L"))).first()[0] or 0) <= MAX_SENT
        prior = classes.agg(arrays(F.log(F.col("CLASSCOUNT").cast("double"))).alias("p")).select(F.col("p")["CLASS"].alias("classes"), F.col("p")["v"].alias("prior"))
        unseen = model.where("VAL is null").agg(*[F.first(F.when(F.col("ATTRIBUTE") == c, F.col("L")), True).alias(f"none{k}") for k, c in enumerate(self.inputs)])
        d = df.select(name(column_id or self.column_id).alias("ID"), *[name(c).alias(f"in{k}") for k, c in enumerate(self.inputs)])
        d = apply_cuts(d, {f"in{self.inputs.index(c)}": at for c, at in self.cuts.items()}).crossJoin(F.broadcast(prior.crossJoin(unseen)))  # one row
        logs = F.col("prior")
        for k, c in enumerate(self.inputs):
            own = model.where((F.col("ATTRIBUTE") == c) & F.col("VAL").isNotNull()).select(F.col("VAL").alias(f"val{k}"), F.col("L").alias(f"l{k}"))
            d = d.join(F.broadcast(own) if few else own.hint("merge"), F.col(f"in{k}").cast("string") == F.col(f"val{k}"), "left")
            of = F.when(F.col(f"in{k}").isNotNull(), F.coalesce(f"l{k}", f"none{k}"))
            logs = F.zip_with(logs, F.coalesce(of, F.transform("prior", lambda p: F.lit(0.0))), lambda a, b: a + b)
        return d.select("ID", "classes", logs.alias("logs"))

    def predict_log(self, df: DataFrame, column_id: str | None = None, mestimation: bool = False) -> DataFrame:
        """ID, CLASS, LOGPROB for every class. A row whose inputs are all null has the classes' own frequencies.

        Without m-estimation a value that a class never has counts as half a row; with it every probability is (n + m p) / (N + m) with
        m the number of the attribute's values and p = 1/m.
        """
        return _by_class(self._logs(df, column_id, mestimation), F.col("logs"), "LOGPROB")

    def predict(self, df: DataFrame, column_id: str | None = None, mestimation: bool = False) -> DataFrame:
        """ID, CLASS: the most probable class, the first by name of equals (to nine digits)."""
        near = self._logs(df, column_id, mestimation).where(F.size("classes") > 0).withColumn("near", F.transform("logs", lambda v: F.round(v, 9)))
        return near.select("ID", F.get("classes", F.array_position("near", F.array_max("near")).cast("int") - 1).alias("CLASS"))

    def predict_proba(self, df: DataFrame, column_id: str | None = None, mestimation: bool = False) -> DataFrame:
        """ID, CLASS, PROB."""
        top = self._logs(df, column_id, mestimation).withColumn("top", F.array_max("logs")).withColumn("e", F.transform("logs", lambda v: F.exp(v - F.col("top"))))
        return _by_class(top.withColumn("whole", F.aggregate("e", F.lit(0.0), lambda s, v: s + v)), F.transform("e", lambda v: v / F.col("whole")), "PROB")

    def fit_predict(self, df: DataFrame, target: str, column_id: str = "ID") -> DataFrame:
        return self.fit(df, target, column_id).predict(df)

    @property
    def labels_(self) -> DataFrame:
        return self.predict(self.fitted)
