"""Queries of learned classifiers and embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, pair_vector
from ..operators import models
from ..operators.tables import shared_folder
from ..sources import readers, sinks

def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .catalog import vector_pairs

    rows = vector_pairs(spark, sf_dir, 1).withColumn("cls", F.when(F.col("label1") == F.col("label2"), "T1").when(F.col("label1") % 2 == 0, "T0").otherwise("T4"))
    rows = models.labelled(rows.withColumn("v", pair_vector(doubles(F.col("a")), doubles(F.col("b")))), F.col("v"), "cls").select("id1", "id2", "features", "label_text")
    return rows.where("id1 % 5 <> 0"), rows.where("id1 % 5 = 0")  # train and test of one classifier


def rf_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest on embedding pair vectors: actual and predicted class of the test pairs."""
    train, test = _vectors(spark, sf_dir)
    return models.predict(models.fit(train, kind="forest", trees=20, depth=5), test).select("id1", "id2", "actual", "predicted")


def ovr_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One boosted model per class on the same pairs."""
    train, test = _vectors(spark, sf_dir)
    return models.predict(models.fit(train, kind="boosted", trees=5, depth=3), test).select("id1", "id2", "actual", "predicted")


def function_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch embedding interface on all documents, with a stand-in model that has no weights: letter frequencies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = models.embed(docs, "text", "embedding", models.letter_model())
    return rows.select("doc_id", F.size("embedding").alias("width"), *(F.round(F.element_at("embedding", i).cast("double"), 4).alias(f"e{i}") for i in (1, 5, 20)))


_LETTERS = ", ".join(f"(length(t) - length(replace(t, '{c}', '')))" for c in models.LETTERS)
_LETTER_SQL = f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), v AS (SELECT doc_id, [{_LETTERS}] AS e FROM d),
n AS (SELECT doc_id, len(e) AS width, e, sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM v)
SELECT doc_id, CAST(width AS INTEGER) AS width, {', '.join(f'round(CASE WHEN norm = 0 THEN 0.0 ELSE e[{i}] / norm END, 4) AS e{i}' for i in (1, 5, 20))} FROM n"""


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline written, read back and applied: test pairs, and how many of its predictions differ."""
    train, test = _vectors(spark, sf_dir)
    model = models.fit(train, kind="forest", trees=5, depth=4)
    path = f"{shared_folder(spark)}/clonelens-io/{uuid.uuid4().hex}"
    sinks.save_model(model, path)
    one, two = models.predict(model, test), models.predict(readers.load_model(spark, path), test)
    both = one.select("id1", "predicted").join(two.select("id1", F.col("predicted").alias("again")), "id1")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") != F.col("again")).alias("different"))


def label_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class numbers of a fitted model, through the label map document."""
    train, _ = _vectors(spark, sf_dir)
    path = f"{shared_folder(spark)}/clonelens-io/{uuid.uuid4().hex}.json"
    sinks.label_map(spark, models.class_labels(models.fit(train, kind="forest", trees=1, depth=1)), path)
    return spark.createDataFrame([(int(k), v) for k, v in readers.metrics_json(spark, path, {}).items()], "place int, clone_type string")


def boosted_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosting with early stopping on the valid pairs: actual and predicted class of the test pairs."""
    rows, test = _vectors(spark, sf_dir)
    model = models.fit_boosted(rows.where("id1 % 5 <> 1"), rows.where("id1 % 5 = 1"), rounds=20, depth=3)
    return model.predict(test).select("id1", "id2", "actual", "predicted")


_PAIRS_SQL = "SELECT a.vec_id AS id1, CASE WHEN a.label = b.label THEN 'T1' WHEN a.label % 2 = 0 THEN 'T0' ELSE 'T4' END AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rf_multiclass": rf_multiclass,
    "ovr_gbt": ovr_gbt,
    "boosted_early_stop": boosted_early_stop,
    "function_embedding": function_embedding,
    "model_round_trip": model_round_trip,
    "label_indices": label_indices,
}
ORACLES: dict[str, str] = {
    "function_embedding": _LETTER_SQL,
    "model_round_trip": f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM ({_PAIRS_SQL}) WHERE id1 % 5 = 0",
    "label_indices": f"SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS place, c AS clone_type FROM (SELECT DISTINCT c FROM ({_PAIRS_SQL}) WHERE id1 % 5 <> 0)",
}
