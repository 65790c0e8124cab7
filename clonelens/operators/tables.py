"""Stored intermediate tables and distributed row positions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all machines see. Where it is unset: one of our own in local mode (tests); on a
    cluster that raises, since no other machine would read it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: stored tables need a folder that all machines share")
        base = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _checkpoint_dir(spark: SparkSession) -> str | None:
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get() if now.isDefined() else None


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/clonelens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, group: str | None, order: list[Column | str], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in its group, in the given (total) order, and the group's size.

    No task sees a whole group: rows are range-partitioned by group and order, numbered inside their partition, and
    shifted by the sizes of the partitions before (one row per partition and group; Spark broadcasts it if it is small).
    """
    keys = ([group] if group else []) + list(order)
    ranged = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "positions")
    own = ["_part"] + ([group] if group else [])
    counts = ranged.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*([group] if group else [])).orderBy("_part")
    whole = W.partitionBy(*([group] if group else []))
    shifts = counts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn(f"{name}_of", F.sum("_n").over(whole)).drop("_n")
    joined = ranged.alias("r").join(shifts.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in own])
    inside = F.row_number().over(W.partitionBy(*[F.col(f"r.{k}") for k in own]).orderBy(*[F.col(f"r.{c}") if isinstance(c, str) else c for c in order]))
    columns = [F.col(f"r.{c}") for c in df.columns]
    return joined.withColumn(name, (inside + F.col("_before")).cast("bigint")).select(*columns, name, F.col(f"{name}_of").cast("bigint"))


def shuffled(key: str, seed: int = 42) -> Column:
    """Deterministic random order: md5(seed:key), the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
