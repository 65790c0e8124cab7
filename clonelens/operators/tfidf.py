"""Sparse TF-IDF in long form: vocabulary, smoothed IDF, normalised weights, cosine of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON

MAX_FEATURES = 1000


def term_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, n of each document."""
    return df.select(F.col(key).alias("key"), F.explode(tokens).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, size: int = MAX_FEATURES) -> DataFrame:
    """The terms of largest total count (ties by term) with their document frequency: term, total, df."""
    return counts.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(size)


def idf(vocab: DataFrame, documents: DataFrame) -> DataFrame:
    """Smoothed inverse document frequency: ln((1 + N) / (1 + df)) + 1."""
    n = documents.agg(F.count(F.lit(1)).alias("docs"))
    return vocab.crossJoin(F.broadcast(n)).select("term", "total", "df", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def fit(counts: DataFrame, pairs: DataFrame, size: int = MAX_FEATURES) -> DataFrame:
    """Vocabulary and IDF of the functions of ``pairs(id1, id2)``: every side of every pair is a document, so a function
    counts as often as it occurs. term, total, df, idf, and ``at``: the term's place in alphabetical order from 0."""
    times = pairs.select(F.explode(F.array("id1", "id2")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    own = counts.join(times, "key").groupBy("term").agg(F.sum(F.col("n") * F.col("times")).alias("total"), F.sum("times").alias("df"))
    vocab = own.orderBy(F.desc("total"), "term").limit(size)
    n = times.agg(F.sum("times").alias("docs"))
    found = vocab.crossJoin(F.broadcast(n)).select("term", "total", "df", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    return found.withColumn("at", F.row_number().over(W.orderBy("term")) - 1)  # MAX_FEATURES rows at most


def weights(counts: DataFrame, idfs: DataFrame) -> DataFrame:
    """key, term, w: counts times IDF, with unit length per document. The vocabulary has a fixed size."""
    raw = counts.join(F.broadcast(idfs.select("term", "idf")), "term").select("key", "term", (F.col("n") * F.col("idf")).alias("w"))
    length = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, "key").select("key", "term", (F.col("w") / F.col("len")).alias("w"))


def pair_cosine(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """id1, id2, cosine: only shared terms are joined; pairs without one have 0."""
    left = pairs.join(weighted.select(F.col("key").alias("id1"), "term", F.col("w").alias("w1")).hint("merge"), "id1")
    shared = left.join(weighted.select(F.col("key").alias("id2"), "term", F.col("w").alias("w2")).hint("merge"), ["id2", "term"])
    dot = shared.groupBy("id1", "id2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    return pairs.join(dot, ["id1", "id2"], "left").select("id1", "id2", (F.coalesce("dot", F.lit(0.0)) / (1 + EPSILON)).alias("cosine"))


def pair_vectors(pairs: DataFrame, weighted: DataFrame, vocab: DataFrame, size: int = MAX_FEATURES) -> DataFrame:
    """Sparse lexical pair vectors of ``pairs(id1, id2)``: id1, id2, width, indices, values. ``size`` differences, then
    ``size`` products, then the cosine; only terms that a side holds have entries (a dense vector is mostly zeros)."""
    term = vocab.select("term", "at")
    held = F.broadcast(term)  # MAX_FEATURES rows at most
    own = weighted.join(held, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("held"))
    left, right = own.select(F.col("key").alias("id1"), F.col("held").alias("x")), own.select(F.col("key").alias("id2"), F.col("held").alias("y"))
    none = F.create_map().cast("map<int,double>")
    both = pairs.select("id1", "id2").join(left, "id1", "left").join(right, "id2", "left")
    both = both.withColumns({"x": F.coalesce("x", none), "y": F.coalesce("y", none)})
    merged = F.map_zip_with("x", "y", lambda _, a, b: F.struct(F.coalesce(a, F.lit(0.0)).alias("x"), F.coalesce(b, F.lit(0.0)).alias("y")))
    rows = both.select("id1", "id2", F.array_sort(F.map_entries(merged)).alias("t"))
    total = lambda f: F.aggregate("t", F.lit(0.0), lambda s, e: s + f(e["value"]["x"], e["value"]["y"]))
    cosine = total(lambda x, y: x * y) / (F.sqrt(total(lambda x, y: x * x)) * F.sqrt(total(lambda x, y: y * y)) + EPSILON)
    shared = F.filter("t", lambda e: (e["value"]["x"] != 0) & (e["value"]["y"] != 0))
    indices = F.concat(F.transform("t", lambda e: e["key"]), F.transform(shared, lambda e: e["key"] + size), F.array(F.lit(2 * size)))
    values = F.concat(F.transform("t", lambda e: F.abs(e["value"]["x"] - e["value"]["y"])), F.transform(shared, lambda e: e["value"]["x"] * e["value"]["y"]), F.array(cosine))
    return rows.select("id1", "id2", F.lit(2 * size + 1).alias("width"), indices.alias("indices"), values.alias("values"))


def with_dense(vectors: DataFrame, dense: Column) -> DataFrame:
    """Sparse vectors (width, indices, values) with a dense array put behind them."""
    after = F.transform(dense, lambda _, i: F.col("width") + i)
    return vectors.withColumns({"indices": F.concat("indices", after), "values": F.concat("values", dense.cast("array<double>")), "width": F.col("width") + F.size(dense)})
