"""Row-local operators on streams: lexing and threshold prediction run unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import java_tokens
from ..functions.taxonomy import predicted
from ..operators.pairs import overlap_measures


def score_stream(pairs: DataFrame, threshold: float) -> DataFrame:
    """Add overlap measures and the prediction to streamed ``func1, func2`` rows, without state.

    The multiset intersection is a sum over the distinct tokens that both sides hold.
    """
    rows = pairs.withColumns({"tokens1": java_tokens(F.col("func1")), "tokens2": java_tokens(F.col("func2"))})
    count = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    both = F.array_intersect("tokens1", "tokens2")
    shared = F.aggregate(both, F.lit(0), lambda s, t: s + F.least(count(F.col("tokens1"), t), count(F.col("tokens2"), t)))
    scored = rows.select("*", *overlap_measures(F.size("tokens1"), F.size("tokens2"), shared)).drop("tokens1", "tokens2")
    return scored.withColumn("prediction", predicted(F.col("overlap_similarity"), threshold))


def class_counts(rows: DataFrame) -> DataFrame:
    """Running counts per class (complete or update mode)."""
    return rows.groupBy("clone_type").agg(F.count(F.lit(1)).alias("n"))
