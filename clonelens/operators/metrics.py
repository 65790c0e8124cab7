"""Evaluation in long form: confusion counts, binary and multiclass reports, threshold sweep and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import REPORT_ORDER, REVIEW
from ..functions.vectors import safe_divide

#: The sort keys of each selection strategy, all descending; the recall that the constrained one needs.
STRATEGIES = {
    "review_f1": ("f1_review_required", "recall_review_required", "precision_review_required", "macro_f1", "threshold"),
    "macro_f1": ("macro_f1", "balanced_accuracy", "f1_review_required", "recall_no_alert", "threshold"),
    "balanced_accuracy": ("balanced_accuracy", "macro_f1", "f1_review_required", "recall_no_alert", "threshold"),
    "constrained_review_f1": ("f1_review_required", "macro_f1", "balanced_accuracy", "recall_review_required", "precision_review_required", "threshold"),
}
LEAST_RECALL = 0.70
FALLBACK = "macro_f1_fallback_no_threshold_met_no_alert_recall_constraint"


def binary_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """All metrics of a 2 x 2 table (review_required is positive); 0 where a denominator is 0."""
    n = tp + fp + tn + fn
    pn, rn = safe_divide(tn, tn + fn), safe_divide(tn, tn + fp)
    pr, rr = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    f1n, f1r = safe_divide(2 * pn * rn, pn + rn), safe_divide(2 * pr * rr, pr + rr)
    return {
        "accuracy": safe_divide(tp + tn, n), "precision_no_alert": pn, "recall_no_alert": rn, "f1_no_alert": f1n,
        "precision_review_required": pr, "recall_review_required": rr, "f1_review_required": f1r, "macro_f1": (f1n + f1r) / 2,
        "weighted_f1": safe_divide(f1n * (tn + fp) + f1r * (tp + fn), n), "balanced_accuracy": (rn + rr) / 2,
        "false_positive_rate": safe_divide(fp, fp + tn), "predicted_review_rate": safe_divide(tp + fp, n),
    }


def binary_counts(actual: Column, predicted: Column) -> list[Column]:
    a, p = actual == REVIEW, predicted == REVIEW
    cells = {"tp": a & p, "fp": ~a & p, "tn": ~a & ~p, "fn": a & ~p}
    return [F.count_if(c).alias(k) for k, c in cells.items()]


def with_binary_metrics(counts: DataFrame) -> DataFrame:
    """Add all metrics to rows of tp, fp, tn, fn."""
    cells = [F.col(c) for c in ("tp", "fp", "tn", "fn")]
    return counts.withColumns(binary_columns(*cells)).withColumn("support", sum(cells[1:], cells[0]))


def binary_metrics(rows: DataFrame, actual: str = "binary_target", predicted: str = "prediction") -> DataFrame:
    """One row of counts and metrics over the rows with a target."""
    return with_binary_metrics(rows.where(F.col(actual).isNotNull()).agg(*binary_counts(F.col(actual), F.col(predicted))))


def confusion(rows: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Long confusion matrix: every cell of labels x labels, zeros included."""
    spark = rows.sparkSession
    axis = spark.createDataFrame([(x,) for x in labels], "l string")
    cells = axis.select(F.col("l").alias("actual")).crossJoin(axis.select(F.col("l").alias("predicted")))  # a fixed list squared
    n = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(cells).join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confusion_wide(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """Labelled matrix: one row per actual class, one column per predicted class."""
    return matrix.groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Per-class precision, recall, F1 and support, from a long confusion matrix."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    by_actual = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_predicted = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    p, r = safe_divide(F.col("tp"), F.col("called")), safe_divide(F.col("tp"), F.col("support"))
    return by_actual.join(by_predicted, "class").select("class", p.alias("precision"), r.alias("recall"), safe_divide(2 * p * r, p + r).alias("f1"), "support", "tp")


def multiclass_report(matrix: DataFrame) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages: class, precision, recall, f1, support."""
    rows = class_report(matrix)
    n = F.sum("support")
    accuracy = safe_divide(F.sum("tp"), n)
    mean = lambda c: F.avg(c)
    weighted = lambda c: safe_divide(F.sum(F.col(c) * F.col("support")), n)
    names = ("precision", "recall", "f1")
    summary = rows.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *(accuracy.alias(c) for c in names), n.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *(mean(c).alias(c) for c in names), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *(weighted(c).alias(c) for c in names), n.alias("support")),
        ).alias("s")
    )
    return rows.select("class", *names, "support").unionByName(summary.select(F.inline("s")))


def sweep(rows: DataFrame, score: str, actual: str = "binary_target", steps: int = 100) -> DataFrame:
    """Metrics at the thresholds 0, 1/steps, ..., 1 over the rows with a target.

    Rows are first counted by score and target, so that the 101 thresholds meet distinct scores, not rows; and each
    score meets only the thresholds up to it: the counts of a step are sums over the steps at or above.
    """
    n = rows.where(F.col(actual).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(actual) == REVIEW).alias("pos"), F.count_if(F.col(actual) != REVIEW).alias("neg")
    )
    grid = F.array(*(F.lit(i / steps) for i in range(steps + 1)))
    # the highest threshold that the score reaches, compared as doubles; -1 below 0, NaN reaches none
    reached = F.when(F.isnan(score), F.lit(0)).otherwise(F.size(F.filter(grid, lambda t: F.col(score) >= t))) - 1
    per_step = n.groupBy(reached.alias("step")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = rows.sparkSession.range(steps + 1).select(F.col("id").alias("k"), (F.col("id") / F.lit(float(steps))).alias("threshold"))
    joined = per_step.join(F.broadcast(every), F.lit(True), "right")  # at most steps + 2 rows against steps + 1
    above, tot = F.col("step") >= F.col("k"), lambda c: F.coalesce(F.sum(c), F.lit(0))
    cells = joined.groupBy("threshold").agg(
        tot(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), tot(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        tot(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"), tot(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
    )
    return with_binary_metrics(cells)


def select_threshold(swept: DataFrame, strategy: str) -> DataFrame:
    """The row of the best threshold under a strategy, and the name of the strategy that decided.

    The constrained strategy falls back to macro_f1 when no row has the recall it needs, and says so.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")

    def best(rows: DataFrame, keys: str, name: str, rank: int) -> DataFrame:
        top = rows.orderBy(*(F.desc(k) for k in STRATEGIES[keys])).limit(1)
        return top.withColumn("selected_by", F.lit(name)).withColumn("_rank", F.lit(rank))

    if strategy != "constrained_review_f1":
        return best(swept, strategy, strategy, 0).drop("_rank")
    met = best(swept.where(F.col("recall_no_alert") >= LEAST_RECALL), strategy, strategy, 0)
    return met.unionByName(best(swept, "macro_f1", FALLBACK, 1)).orderBy("_rank").limit(1).drop("_rank")


def review_rates(rows: DataFrame, cls: str = "clone_type", predicted: str = "prediction", order: tuple[str, ...] = REPORT_ORDER) -> DataFrame:
    """Share of each class sent to review, in report order, over all rows; classes without rows are zero."""
    fixed = rows.sparkSession.createDataFrame(list(enumerate(order)), "place int, original_class string")
    n = rows.groupBy(F.col(cls).alias("original_class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(predicted) == REVIEW).alias("predicted_review_required"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = fixed.join(n, "original_class", "left").withColumns({c: zero(c) for c in ("support", "predicted_review_required")})
    rate = safe_divide(F.col("predicted_review_required"), F.col("support"))
    return out.select("place", "original_class", "support", "predicted_review_required", rate.alias("recall_as_review_required"))


def contextual_report(rows: DataFrame, cls: str = "clone_type", predicted: str = "prediction", contextual: str = "T4") -> DataFrame:
    """Support and review rate of the contextual class."""
    own = rows.where(F.col(cls) == contextual).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(predicted) == REVIEW).alias("predicted_review_required"))
    note = f"{contextual} is outside the main binary comparison and reported beside it."
    return own.select("support", "predicted_review_required", safe_divide(F.col("predicted_review_required"), F.col("support")).alias("review_required_rate"), F.lit(note).alias("note"))


def main_rows(rows: DataFrame, contextual: str = "T4") -> DataFrame:
    """Prediction rows of the strict comparison: neither actual nor predicted class is the contextual one."""
    return rows.where((F.col("actual") != contextual) & (F.col("predicted") != contextual))


def prediction_rows(rows: DataFrame, targets: dict[str, Column]) -> DataFrame:
    """Projection of multiclass predictions: binary labels, exclusion, and correctness (null when excluded)."""
    excluded = targets["actual"].isNull() | targets["predicted"].isNull()
    label = lambda c: F.coalesce(c, F.lit("contextual_t4"))
    return rows.select(
        "*", label(targets["actual"]).alias("binary_label"), label(targets["predicted"]).alias("predicted_binary"),
        excluded.alias("excluded_from_main_eval"), F.when(~excluded, targets["actual"] == targets["predicted"]).alias("correct_binary"),
    )


def error_slices(rows: DataFrame, negative: str = "T0") -> DataFrame:
    """false_positive and false_negative rows of the negative class, with a ``slice`` column."""
    fp = (F.col("actual") == negative) & (F.col("predicted") != negative)
    fn = (F.col("actual") != negative) & (F.col("predicted") == negative)
    return rows.withColumn("slice", F.when(fp, "false_positive").when(fn, "false_negative")).where("slice is not null")


