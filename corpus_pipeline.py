"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir), deletes the tables that its predecessor left in the shared folder (that stage's
result has been written by then; tables of other queries are left alone), reads all its predecessor kept, and returns a
DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it again as the next stage's docs. All stages but the last return
the columns of documents (n_chars is that of the text as it then is).

ORACLE_SQL is None: the perplexity model, the similarity classes and the tokenizer can't be written in SQL; the
stages are tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelens.llm.common import Scratch, materialise, small_batches
from clonelens.llm.decontamination import without_leaks
from clonelens.llm.ngram_join import Join, one_per_class
from clonelens.llm.packing import pack_documents
from clonelens.llm.quality import keep_documents
from clonelens.llm.repeats import without_repeats

#: Repeated passages: strings of this many bytes. Passages of more than 50 words are longer in any language with words.
PASSAGE_BYTES = 200
#: Near duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
NEAR = Join(words=5, num=80, den=100)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The last stage of this thread's run, and what it left in the shared folder.
_left = threading.local()


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        order = [f for _, f in STAGES]
        before, scratch = getattr(_left, "stage", None), getattr(_left, "scratch", None)
        if before in order[:-1] and order[order.index(before) + 1] is run:
            scratch.delete(spark)
        small_batches(spark)
        _left.stage, _left.scratch = run, Scratch()
        with _left.scratch:
            return function(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the perplexity bands keep."""
    return keep_documents(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id."""
    return one_per_class(docs, NEAR)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of PASSAGE_BYTES that occur twice or more in what is left of the corpus."""
    cut = without_repeats(docs, PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


@_stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
