"""Queries of the training-data operators over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    small_batches(spark)
    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import component_report

    small_batches(spark)
    return component_report(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    small_batches(spark)
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leak_report

    small_batches(spark)
    return leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, insecure_hosts, judge_urls

    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, RULES, insecure_hosts(pages))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_report

    small_batches(spark)
    return archive_report(_table(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeat_report

    small_batches(spark)
    return repeat_report(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_report

    return license_report(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    small_batches(spark)
    return quality_report(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    small_batches(spark)
    return pack_documents(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = {
        "op1_toxicity": op1_toxicity,
        "op2_ngram_join": op2_ngram_join,
        "op3_html_text": op3_html_text,
        "op4_decontamination": op4_decontamination,
        "op5_url_filter": op5_url_filter,
        "op6_warc": op6_warc,
        "op7_repeats": op7_repeats,
        "op8_license_scan": op8_license_scan,
        "op9_quality": op9_quality,
        "op10_packing": op10_packing,
        "pipeline": pipeline,
    }
    return found


def oracle_sql() -> dict[str, str]:
    from . import decontamination, license_scan, url_filter, warc

    return {
        "op4_decontamination": decontamination.oracle_sql(),
        "op5_url_filter": url_filter.oracle_sql(),
        "op6_warc": warc.oracle_sql(),
        "op8_license_scan": license_scan.oracle_sql(),
    }
