"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "clonelens", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
