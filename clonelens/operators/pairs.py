"""Pair relations: canonical pairs, dataset unification, neighbour pairs, token overlap features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import clone_type, pair_class
from ..functions.vectors import safe_divide
from .tables import positions


def canonical(df: DataFrame, one: str, two: str) -> DataFrame:
    """Add ``low`` and ``high``, the pair in one orientation."""
    return df.withColumn("low", F.least(one, two)).withColumn("high", F.greatest(one, two))


def typed_pairs(clones: DataFrame, line: str) -> DataFrame:
    """Class per canonical pair of metadata rows; of repeated pairs the last line wins."""
    rows = canonical(clones.withColumn("cls", clone_type(F.col("SYNTACTIC_TYPE"), F.col("SIMILARITY_TOKEN"))), "FUNCTION_ID_ONE", "FUNCTION_ID_TWO")
    return rows.groupBy("low", "high").agg(F.max_by("cls", line).alias("cls"))


def needed_clones(clones: DataFrame, pairs: DataFrame) -> DataFrame:
    """Metadata rows that a positive pair asks for, in either orientation (left semi join on the canonical pair)."""
    wanted = canonical(pairs.where(F.col("label") == "1"), "id1", "id2").select("low", "high").distinct()
    return canonical(clones, "FUNCTION_ID_ONE", "FUNCTION_ID_TWO").join(wanted, ["low", "high"], "left_semi").drop("low", "high")


def unify(pairs: DataFrame, functions: DataFrame, clones: DataFrame, line: str = "line") -> DataFrame:
    """Unified records of ``pairs(id1, id2, label)``: both texts (empty when unknown), label, clone type, and what other
    columns the pairs have."""
    others = [c for c in pairs.columns if c not in ("id1", "id2", "label")]
    types = typed_pairs(needed_clones(clones, pairs), line)
    f1 = functions.select(F.col("idx").alias("id1"), F.col("func").alias("func1"))
    f2 = functions.select(F.col("idx").alias("id2"), F.col("func").alias("func2"))
    joined = canonical(pairs, "id1", "id2").join(types, ["low", "high"], "left").join(f1, "id1", "left").join(f2, "id2", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return joined.select("id1", "id2", text("func1"), text("func2"), F.col("label").cast("int").alias("label"), pair_class(F.col("label"), F.col("cls")).alias("clone_type"), *others)


def neighbour_pairs(df: DataFrame, key: str, group: str, order: list[str], reach: int = 5) -> DataFrame:
    """Each row with the next ``reach`` rows of its group's order: linear in the rows, an equi-join on the position."""
    placed = positions(df.select(key, group, *[c for c in order if c not in (key, group)]), group, order)
    left = placed.select(F.col(key).alias("id1"), F.col(group), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("step"), "position")
    right = placed.select(F.col(key).alias("id2"), F.col(group), F.col("position").alias("at"))
    return left.withColumn("at", F.col("position") + F.col("step")).join(right, [group, "at"]).select("id1", "id2")


def token_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, token (64-bit hash), n: the token multiset of each text in long form."""
    return df.select(F.col(key).alias("key"), F.explode(tokens).alias("t")).groupBy("key", F.xxhash64("t").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def token_bags(counts: DataFrame) -> DataFrame:
    """key, bag, total of token counts: the k-th occurrence of a token has a hash of its own, so that the intersection of
    two bags as sets is that of the multisets."""
    each = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.xxhash64("token", k))
    return counts.groupBy("key").agg(F.flatten(F.collect_list(each)).alias("bag"), F.sum("n").alias("total"))


def overlap_features(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Overlap measures of ``pairs(id1, id2)`` from token counts: multiset intersection, Jaccard, containments.

    Each text is tokenized once, whatever the number of its pairs, and a pair is one row with two arrays of longs, not a
    row per token. All measures are 0 when a side has no tokens.
    """
    bags = token_bags(counts)
    one = bags.select(F.col("key").alias("id1"), F.col("bag").alias("bag1"), F.col("total").alias("t1"))
    two = bags.select(F.col("key").alias("id2"), F.col("bag").alias("bag2"), F.col("total").alias("t2"))
    joined = pairs.select("id1", "id2").join(one.hint("merge"), "id1", "left").join(two.hint("merge"), "id2", "left")
    shared = F.coalesce(F.size(F.array_intersect("bag1", "bag2")), F.lit(0))
    shared = F.when(F.col("bag1").isNull() | F.col("bag2").isNull(), 0).otherwise(shared)
    return joined.select("id1", "id2", *overlap_measures(F.coalesce("t1", F.lit(0)), F.coalesce("t2", F.lit(0)), shared))


def overlap_measures(t1: Column, t2: Column, shared: Column) -> list[Column]:
    return [
        t1.cast("bigint").alias("tokens_func1"),
        t2.cast("bigint").alias("tokens_func2"),
        shared.cast("bigint").alias("shared_token_overlap"),
        safe_divide(shared, F.least(t1, t2)).alias("overlap_similarity"),
        safe_divide(shared, t1 + t2 - shared).alias("jaccard_similarity"),
        safe_divide(shared, t1).alias("containment_1_in_2"),
        safe_divide(shared, t2).alias("containment_2_in_1"),
    ]


def contextual_pairs(files: DataFrame, order: list[str]) -> DataFrame:
    """T4 records of whole files ``files(path, prompt, content)``: halves of each, one counter over all prompts."""
    from ..functions.text import split_functions

    placed = positions(files, None, order)
    halves = placed.withColumn("halves", split_functions(F.col("content")))
    ident = lambda k: F.concat(F.lit("GPT_T4_"), F.col("prompt"), F.lit("_"), F.col("position").cast("string"), F.lit(f"_{k}"))
    return halves.select(
        ident(1).alias("id1"), ident(2).alias("id2"), F.col("halves.func1").alias("func1"), F.col("halves.func2").alias("func2"), F.lit(1).alias("label"), F.lit("T4").alias("clone_type")
    )
