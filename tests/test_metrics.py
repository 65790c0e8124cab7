"""Metric arithmetic on integer counts, sweep, selection, sampling and splits."""

import pytest
from pyspark.sql import functions as F

from clonelens.functions import taxonomy as tax
from clonelens.operators import metrics as met
from clonelens.operators import sampling as smp


def test_published_binary_counts(spark):
    row = met.with_binary_metrics(spark.createDataFrame([(1360, 317, 133, 372)], "tp long, fp long, tn long, fn long")).first()
    for name, value in {"accuracy": 0.68423, "macro_f1": 0.53821, "weighted_f1": 0.69078, "balanced_accuracy": 0.54039, "precision_no_alert": 0.26337,
                        "f1_no_alert": 0.27853, "recall_review_required": 0.78522, "false_positive_rate": 0.70444, "predicted_review_rate": 0.76856}.items():
        assert row[name] == pytest.approx(value, abs=6e-6)


def test_empty_denominators_are_zero(spark):
    row = met.with_binary_metrics(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, tn long, fn long")).first()
    assert all(row[c] == 0 for c in row.asDict() if c not in ("tp", "fp", "tn", "fn"))


def test_sweep_equals_counting_row_by_row(spark):
    scores = [0.0, 0.005, 0.29, 0.29, 0.5, 0.999, 1.0, 0.7, 0.3]
    rows = [(s, tax.REVIEW if i % 2 else tax.NO_ALERT) for i, s in enumerate(scores)] + [(0.4, None)]
    got = {round(r["threshold"] * 100): r for r in met.sweep(spark.createDataFrame(rows, "score double, binary_target string"), "score").collect()}
    assert len(got) == 101
    for i in range(101):
        t = i / 100
        tp = sum(s >= t and y == tax.REVIEW for s, y in rows)
        fp = sum(s >= t and y == tax.NO_ALERT for s, y in rows)
        assert (got[i]["tp"], got[i]["fp"], got[i]["support"]) == (tp, fp, 9)


def test_nan_score_reaches_no_threshold(spark):
    rows = spark.createDataFrame([(float("nan"), tax.REVIEW)], "score double, binary_target string")
    assert {(r["tp"], r["fn"]) for r in met.sweep(rows, "score").collect()} == {(0, 1)}


def test_constrained_selection_falls_back(spark):
    rows = spark.createDataFrame([(1.0, tax.NO_ALERT)] * 4 + [(0.5, tax.REVIEW)] * 4, "score double, binary_target string")
    swept = met.sweep(rows, "score").where("threshold <= 0.9")
    assert met.select_threshold(swept, "constrained_review_f1").first()["selected_by"] == met.FALLBACK
    assert met.select_threshold(swept, "review_f1").first()["threshold"] == 0.5
    with pytest.raises(ValueError):
        met.select_threshold(swept, "other")


def test_confusion_has_every_cell_and_report_has_zero_rows(spark):
    rows = spark.createDataFrame([("T0", "T0"), ("T0", "T1")], "actual string, predicted string")
    matrix = met.confusion(rows, ["T0", "T1", "T2"])
    assert matrix.count() == 9
    report = {r["class"]: r for r in met.multiclass_report(matrix).collect()}
    assert report["T2"]["f1"] == 0 and report["accuracy"]["precision"] == 0.5 and report["T0"]["recall"] == 0.5


def test_targets(spark):
    rows = spark.createDataFrame([(c,) for c in tax.CLASSES], "c string")
    got = {r["c"]: (r["t"], r["p"]) for r in rows.select("c", tax.binary_target(F.col("c")).alias("t"), tax.product_category(F.col("c")).alias("p")).collect()}
    assert got["T0"] == ("no_alert", "no_alert") and got["T4"][0] is None and got["MT3"] == ("review_required", "modified_clone")
    with pytest.raises(Exception, match="unsupported clone_type"):
        spark.createDataFrame([("X",)], "c string").select(tax.binary_target(F.col("c"))).collect()
    with pytest.raises(ValueError):
        tax.checked_threshold(1.5)


def test_split_sizes_are_exact(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, "a").otherwise("b").alias("cls"))
    got = {(r["cls"], r["split"]): r["count"] for r in smp.stratified_split(rows, "cls", "id").groupBy("cls", "split").count().collect()}
    assert got == {("a", "train"): 490, ("a", "valid"): 105, ("a", "test"): 105, ("b", "train"): 210, ("b", "valid"): 45, ("b", "test"): 45}
    assert {r["split"]: r["count"] for r in smp.positional_split(rows, "id").groupBy("split").count().collect()} == {"train": 800, "valid": 100, "test": 100}
    assert smp.undersample(rows, "cls", "id", 500).count() == 800
