"""Deterministic balancing and splitting on md5 order: exact class sizes, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import positions, shuffled


def undersample(df: DataFrame, cls: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per class, drawn without replacement; each task keeps ``cap`` rows of a class before the
    shuffle (window group limit), so a hot class stays small."""
    rank = F.row_number().over(W.partitionBy(cls).orderBy(shuffled(key, seed), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def stratified_split(df: DataFrame, cls: str, key: str, cuts: tuple[int, int] = (70, 85), seed: int = 42) -> DataFrame:
    """Add ``split``: train, valid, test cut at the given percentages of every class."""
    placed = positions(df.withColumn("_order", shuffled(key, seed)), cls, ["_order", key])
    return _cut(placed, cuts).drop("_order")


def positional_split(df: DataFrame, key: str, cuts: tuple[int, int] = (80, 90), seed: int = 42) -> DataFrame:
    """Add ``split`` over the whole table in shuffled order."""
    placed = positions(df.withColumn("_order", shuffled(key, seed)), None, ["_order", key])
    return _cut(placed, cuts).drop("_order")


def _cut(placed: DataFrame, cuts: tuple[int, int]) -> DataFrame:
    at, n = 100 * F.col("position"), F.col("position_of")  # whole numbers: 0.7 * 700 is below 490 as a double
    split = F.when(at <= n * cuts[0], "train").when(at <= n * cuts[1], "valid").otherwise("test")
    return placed.withColumn("split", split).drop("position", "position_of")


def split_leakage(df: DataFrame, text: str) -> DataFrame:
    """Texts that stand in more than one split: text and number of splits."""
    return df.groupBy(text).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
