"""Logistic models on weighted rows, blends and rules."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.errors import DataValidationError


def standardizer(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where it is 0) of each column of the training rows."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardize(rows: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c).cast("double") - m) / s for c, (m, s) in fitted.items()})


class BalancedLogistic:
    """L2 logistic regression on standardised columns, classes weighted by n / (2 * n of the class)."""

    def __init__(self, columns: list[str], c: float = 1.0, max_iter: int = 1000):
        self.columns, self.c, self.max_iter = columns, c, max_iter

    def fit(self, train: DataFrame) -> "BalancedLogistic":
        self.fitted = standardizer(train, self.columns)
        counts = dict(train.groupBy("label").count().collect())
        total = sum(counts.values())
        weight = F.coalesce(*[F.when(F.col("label") == k, F.lit(total / (len(counts) * n))) for k, n in counts.items()])
        rows = self._vectors(train).withColumn("_w", weight).withColumn("_y", F.col("label").cast("double"))
        model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (self.c * total), elasticNetParam=0.0, standardization=False, maxIter=self.max_iter, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred")
        self.model = model.fit(rows)
        if set(counts) != {0, 1}:
            raise DataValidationError(f"labels {sorted(counts)} where 0 and 1 are needed")
        return self

    def _vectors(self, rows: DataFrame) -> DataFrame:
        inner = [f"_f_{c}" for c in self.columns]
        t = rows.withColumns({i: (F.col(c).cast("double") - self.fitted[c][0]) / self.fitted[c][1] for i, c in zip(inner, self.columns)})
        return VectorAssembler(inputCols=inner, outputCol="_x").transform(t).drop(*inner)

    def predict(self, rows: DataFrame, name: str = "p") -> DataFrame:
        """`rows` with the probability of label 1; `fit` has seen to it that the model's classes are the labels 0 and 1."""
        scored = self.model.transform(self._vectors(rows))
        return scored.withColumn(name, vector_to_array("_p")[1]).drop("_x", "_p", "_raw", "_pred")


def cross_fit(rows: DataFrame, columns: list[str], folds: int, c: float = 1.0) -> DataFrame:
    """Out-of-fold probabilities of `rows` (fold, label, ...): one fit a fold, on the other folds' rows."""
    parts = [BalancedLogistic(columns, c).fit(rows.where(F.col("fold") != k)).predict(rows.where(F.col("fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def majority_label(train: DataFrame) -> int:
    """The more frequent label; ties give 0."""
    n0, n1 = train.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    return int(n1 > n0)


def substring_rule(response: Column, context: Column) -> Column:
    return ((response != "") & F.contains(context, response)).cast("int")


def exact_support(p: Column, present: Column, response: Column, context: Column) -> Column:
    """The score raised to 0.995 where a long enough normalised response stands in the context."""
    return F.when(present & (F.length(response) >= 8) & F.contains(context, response), 0.995).otherwise(p)


def softmax2(l0: Column, l1: Column) -> Column:
    return 1.0 / (1.0 + F.exp(l0 - l1))
