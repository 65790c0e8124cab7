"""Clone taxonomy as column expressions: grades, labels, binary and product views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The closed class list, the report orders and the grade borders.
CLASSES = ("T0", "T1", "T2", "VST3", "ST3", "MT3", "WT3", "T4")
REVIEW_CLASSES = ("T1", "T2", "VST3", "ST3", "MT3", "WT3")
REPORT_ORDER = ("T1", "T2", "VST3", "ST3", "MT3", "WT3", "T4")
QA_ORDER = ("T0", "T1", "T2", "VST3", "ST3", "MT3", "T4")
GRADES = ((0.90, "VST3"), (0.70, "ST3"), (0.50, "MT3"))
PRODUCT = {"T0": "no_alert", "T1": "direct_copy", "T2": "superficial_rename", "VST3": "modified_clone", "ST3": "modified_clone",
           "MT3": "modified_clone", "WT3": "modified_clone", "T4": "contextual_review"}
NO_ALERT, REVIEW, CONTEXT = "no_alert", "review_required", "contextual_t4"


def grade(similarity: Column) -> Column:
    """Type-3 grade of a numeric similarity. NaN is the weakest grade (Spark would order it above all numbers)."""
    out = F.lit("WT3")
    for border, name in reversed(GRADES):
        out = F.when(~F.isnan(similarity) & (similarity >= border), name).otherwise(out)
    return F.when(similarity.isNull(), "UNKNOWN").otherwise(out)


def clone_type(syntactic: Column, similarity_text: Column) -> Column:
    """Class of a metadata row of text values: types 1 and 2 directly, type 3 by token similarity, else UNKNOWN."""
    return (
        F.when(syntactic == "1", "T1").when(syntactic == "2", "T2").when(syntactic == "3", grade(F.trim(similarity_text).try_cast("double"))).otherwise("UNKNOWN")
    )


def pair_class(label: Column, known_type: Column) -> Column:
    """Class of a labelled pair: label 0 is T0; else the known type, or UNKNOWN_T123 when there is none."""
    return F.when(label == "0", "T0").otherwise(F.coalesce(known_type, F.lit("UNKNOWN_T123")))


def binary_target(cls: Column, include_contextual: bool = False) -> Column:
    """no_alert / review_required; T4 is null unless included; a class outside the taxonomy raises."""
    context = F.lit(REVIEW) if include_contextual else F.lit(None).cast("string")
    unknown = F.raise_error(F.concat(F.lit("unsupported clone_type: "), F.coalesce(cls, F.lit("null"))))
    return F.when(cls == "T0", NO_ALERT).when(cls.isin(*REVIEW_CLASSES), REVIEW).when(cls == "T4", context).otherwise(unknown)


def predicted(score: Column, threshold: float) -> Column:
    return F.when(score >= F.lit(checked_threshold(threshold)), REVIEW).otherwise(NO_ALERT)


def checked_threshold(threshold: float) -> float:
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold outside [0, 1]: {threshold}")
    return float(threshold)


def product_category(cls: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, category in PRODUCT.items():
        out = F.when(cls == name, category).otherwise(out)
    return out


def order_key(cls: Column, order: tuple[str, ...]) -> Column:
    """Place in a preferred order; classes outside it follow (sort by name next)."""
    at = F.array_position(F.array(*map(F.lit, order)), cls)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("int")
