"""Learned classifiers on Spark ML: label order, pair-feature pipelines, prediction, comparison tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def labelled(df: DataFrame, features: Column, label: str) -> DataFrame:
    """features (vector) and label of a pair-feature array."""
    return df.select("*", array_to_vector(features.cast("array<double>")).alias("features")).withColumnRenamed(label, "label_text")


def hybrid_vector(*parts: Column) -> Column:
    """Column-wise concatenation of feature arrays: lexical, structural, embedding."""
    return F.concat(*(p.cast("array<double>") for p in parts))


def classifier(kind: str = "forest", trees: int = 100, depth: int = 6, rate: float = 0.1, seed: int = SEED):
    """A multiclass classifier: random forest, or one boosted binary model per class (Spark's boosting is binary)."""
    if kind == "forest":
        return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    if kind == "boosted":
        return OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed), labelCol="label", featuresCol="features")
    raise ValueError(f"unknown classifier: {kind}")


def fit(train: DataFrame, **options) -> PipelineModel:
    """Fit on rows of features and label_text; classes are numbered in alphabetical order."""
    indexer = StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    decode = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*indexer.labels, "UNKNOWN"])
    return Pipeline(stages=[indexer, classifier(**options), decode]).fit(train)


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with actual and predicted class names; every other column, keys included, is carried."""
    out = model.transform(rows)
    drop = [c for c in ("label", "rawPrediction", "probability", "prediction", "features") if c in out.columns]
    return out.drop(*drop).withColumnRenamed("label_text", "actual")


def embed(df: DataFrame, text: str, out: str, load: Callable[[], Callable], batch: int = 32) -> DataFrame:
    """Add an embedding column by a model that ``load`` makes on the executors: texts to float vectors, in batches."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    return df.withColumn(out, predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch)(F.col(text)))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_model() -> Callable[[], Callable]:
    """A stand-in embedding without weights: frequencies of the letters a to z, of unit length (zeros without letters).
    Same interface as a transformer."""

    def load():
        import numpy as np

        def run(texts):
            out = np.array([[(t or "").lower().count(c) for c in LETTERS] for t in texts], dtype=np.float64).reshape(len(texts), len(LETTERS))
            return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)).astype(np.float32)

        return run

    return load


class Boosted:
    """One boosted binary model per class, each stopped early on validation rows; the largest margin decides, ties going
    to the class that comes first."""

    def __init__(self, labels: list[str], models: list):
        self.labels, self.models = labels, models

    def predict(self, rows: DataFrame) -> DataFrame:
        out, margins = rows, []
        for i, model in enumerate(self.models):
            own = model.copy().setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_probability{i}").setPredictionCol(f"_prediction{i}")
            out = own.transform(out)
            margins.append(F.struct(vector_to_array(f"_raw{i}")[1].alias("margin"), F.lit(-i).alias("place"), F.lit(self.labels[i]).alias("label")))
        best = F.array_max(F.array(*margins))["label"]
        return out.select(*[c for c in rows.columns if c not in ("features", "label_text")], F.col("label_text").alias("actual"), best.alias("predicted"))


def fit_boosted(train: DataFrame, valid: DataFrame, rounds: int = 300, depth: int = 6, rate: float = 0.1, tolerance: float = 0.01, seed: int = SEED) -> Boosted:
    """Fit on ``train(features, label_text)``; every model keeps the rounds up to which its error on ``valid`` falls (by
    ``tolerance`` of itself, Spark's rule for early stopping; XGBoost's patience has no counterpart there)."""
    labels = sorted(r[0] for r in train.select("label_text").distinct().collect())  # the closed class list
    rows = train.select("features", "label_text", F.lit(False).alias("valid")).unionByName(valid.select("features", "label_text", F.lit(True).alias("valid"))).persist()
    fitted = []
    try:
        for label in labels:
            own = rows.withColumn("label", (F.col("label_text") == label).cast("double"))
            fitted.append(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, validationIndicatorCol="valid", validationTol=tolerance, seed=seed).fit(own))
    finally:
        rows.unpersist()
    return Boosted(labels, fitted)


#: Published metrics of two earlier models, for comparison tables.
PUBLISHED = [("tfidf", 0.8454, 0.8730, 0.8449), ("ast", 0.77736, 0.76095, 0.77712)]


def comparison(df: DataFrame) -> DataFrame:
    """model, accuracy, macro_f1, weighted_f1 of the published models and of ``df`` (same columns, any may be missing)."""
    fixed = df.sparkSession.createDataFrame(PUBLISHED, "model string, accuracy double, macro_f1 double, weighted_f1 double")
    return fixed.unionByName(df, allowMissingColumns=True)


def class_rows(reports: dict[str, DataFrame]) -> DataFrame:
    """Per-class reports of several models as one table: model, class, precision, recall, f1, support."""
    out = None
    for model, report in reports.items():
        own = report.select(F.lit(model).alias("model"), "class", "precision", "recall", "f1", "support")
        out = own if out is None else out.unionByName(own)
    return out
