"""K-means over numeric and text columns. A text column is a coordinate for each of its values, so two rows that differ in it are sqrt(2) apart."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.ml.clustering import KMeans as _KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .estimator import Estimator
from .stats import categorical, name, numeric


#: Values of a text column, at most.
MAX_VALUES = 1000

#: Rows of a part of the training rows.
ROWS_A_PART = 50_000


class KMeans(Estimator):
    """distance 'norm_euclidean' scales every input to unit deviation. Rows with a null input are in no cluster: theirs is null."""

    def __init__(self, n_clusters: int = 3, modelname: str | None = None, max_iter: int = 5, distance: str = "euclidean", random_state: int = 12345, idbased: bool = False, statistics: str | None = None) -> None:
        if distance not in ("euclidean", "norm_euclidean"):
            raise ValueError("distance must be 'euclidean' or 'norm_euclidean'")
        if isinstance(n_clusters, bool) or not isinstance(n_clusters, int) or n_clusters < 2:
            raise ValueError("n_clusters must be a whole number from 2 on")
        self.n_clusters, self.modelname, self.max_iter, self.distance = n_clusters, modelname, max_iter, distance
        self.random_state, self.idbased, self.statistics = random_state, idbased, statistics
        self.model = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        """df with the vectors of its rows, without rows that lack an input."""
        x = [name(c).cast("double") for c in self.inputs] + [F.when(name(c).isNotNull(), (name(c) == v).cast("double")) for c in self.nominal for v in self.values[c]]
        d = VectorAssembler(inputCols=[f"__x{k}" for k in range(len(x))], outputCol="__raw", handleInvalid="skip").transform(df.select("*", *[e.alias(f"__x{k}") for k, e in enumerate(x)]))
        return d if self.scaler is None else self.scaler.transform(d)

    def fit(self, df: DataFrame, column_id: str = "ID", incolumn: list[str] | None = None) -> KMeans:
        """Every other numeric or text column is an input by default. A text column may have MAX_VALUES values at most."""
        if column_id not in df.columns:
            raise ValueError(f"no column {column_id}")
        self.column_id = column_id
        asked = [c for c in (incolumn or df.columns) if c != column_id]
        self.inputs, self.nominal = [c for c in asked if c in numeric(df)], [c for c in asked if c in categorical(df)]
        if not self.inputs and not self.nominal:
            raise ValueError("no input")
        self.values = {}
        for c in self.nominal:
            found = df.select(name(c)).where(name(c).isNotNull()).distinct().take(MAX_VALUES + 1)
            if len(found) > MAX_VALUES:
                raise ValueError(f"{c} has over {MAX_VALUES} values")
            self.values[c] = sorted(r[0] for r in found)
        self.scaler = None
        # The rows are kept in memory part by part, so parts are of about equal size. Starting centres are drawn by a row's place: parts
        # and order follow from the rows alone.
        used = [name(c) for c in dict.fromkeys([column_id, *self.inputs, *self.nominal])]
        dealt = df.select(*used)
        dealt = dealt.repartition(dealt.count() // ROWS_A_PART + 1, *used).sortWithinPartitions(*used)
        rows = self._vectors(dealt)
        if self.distance == "norm_euclidean":
            self.scaler = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=False, withStd=True).fit(rows)
            rows = self.scaler.transform(rows)
        column = "__scaled" if self.scaler else "__raw"
        self.model = _KMeans(k=self.n_clusters, maxIter=self.max_iter, seed=self.random_state, featuresCol=column, predictionCol="CLUSTER_ID").fit(rows)
        self.fitted = df
        self.cluster_centers_ = [list(map(float, c)) for c in self.model.clusterCenters()]
        self.inertia_ = self.model.summary.trainingCost
        self.size_clusters = list(self.model.summary.clusterSizes)
        return self

    def predict(self, df: DataFrame, column_id: str | None = None) -> DataFrame:
        """ID, CLUSTER_ID, DISTANCE to its centre."""
        if self.model is None:
            raise ValueError("the model is not fitted")
        rows = self.model.transform(self._vectors(df))
        x = vector_to_array(F.col("__scaled" if self.scaler else "__raw"))
        centers = F.array(*[F.array(*map(F.lit, c)) for c in self.cluster_centers_])
        squares = F.zip_with(x, F.get(centers, F.col("CLUSTER_ID")), lambda a, b: (a - b) * (a - b))
        id_ = name(column_id or self.column_id).alias("ID")
        lacks = reduce(operator.or_, [name(c).isNull() for c in [*self.inputs, *self.nominal]])
        none = df.where(lacks).select(id_, F.lit(None).cast("int").alias("CLUSTER_ID"), F.lit(None).cast("double").alias("DISTANCE"))
        return rows.select(id_, "CLUSTER_ID", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)).alias("DISTANCE")).unionAll(none)

    def fit_predict(self, df: DataFrame, column_id: str = "ID", incolumn: list[str] | None = None) -> DataFrame:
        return self.fit(df, column_id, incolumn).predict(df)

    @property
    def labels_(self) -> DataFrame:
        return self.predict(self.fitted).select("ID", "CLUSTER_ID")

    @property
    def withinss(self) -> DataFrame:
        return self.predict(self.fitted).where("CLUSTER_ID is not null").groupBy("CLUSTER_ID").agg(F.sum(F.col("DISTANCE") * F.col("DISTANCE")).alias("WITHINSS"))

    def tables(self) -> dict[str, DataFrame]:
        """MODEL, COLUMNS, COLUMN_STATISTICS (mean or mode by cluster) and CLUSTERS."""
        spark = self.fitted.sparkSession
        own = self.predict(self.fitted).where("CLUSTER_ID is not null")
        rows = self.fitted.join(own.withColumnRenamed("ID", "__id"), name(self.column_id) == F.col("__id"))
        stats = rows.groupBy("CLUSTER_ID").agg(*[F.avg(name(c)).cast("string").alias(f"n{k}") for k, c in enumerate(self.inputs)], *[F.mode(name(c), True).alias(f"c{k}") for k, c in enumerate(self.nominal)])
        cells = [F.struct(F.lit(c).alias("COLUMNNAME"), F.lit("MEAN").alias("STATISTIC"), F.col(f"n{k}").alias("VALUE")) for k, c in enumerate(self.inputs)] + [F.struct(F.lit(c).alias("COLUMNNAME"), F.lit("MODE").alias("STATISTIC"), F.col(f"c{k}").alias("VALUE")) for k, c in enumerate(self.nominal)]
        return {
            "MODEL": spark.createDataFrame([(self.modelname, "KMeans", self.distance, self.n_clusters, self.max_iter)], "MODELNAME string, ALGORITHM string, DISTANCE string, CLUSTERS int, ITERATIONS int"),
            "COLUMNS": spark.createDataFrame([(c, "continuous") for c in self.inputs] + [(c, "nominal") for c in self.nominal], "COLUMNNAME string, KIND string"),
            "COLUMN_STATISTICS": stats.select("CLUSTER_ID", F.explode(F.array(*cells)).alias("s")).select("CLUSTER_ID", "s.*"),
            "CLUSTERS": own.groupBy("CLUSTER_ID").agg(F.count("*").alias("SIZE"), F.sum(F.col("DISTANCE") * F.col("DISTANCE")).alias("WITHINSS")),
        }
