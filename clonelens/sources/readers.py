"""Readers: JDBC metadata, JSON lines (strict, lenient, silent), whitespace text, CSV, whole files, caches, metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import last_clone_type
from ..schemas import BALANCED, CLONES


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _glob(spark: SparkSession, pattern: str) -> list:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or [])


def jdbc_clones(spark: SparkSession, url: str, table: str = "CLONES", partitions: int = 8, column: str | None = None, bounds: tuple[int, int] = (0, 1), **options: str) -> DataFrame:
    """Five text columns of the clone table; NULL becomes the text ``null``. Partitioned on a numeric column if named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load().select(*(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in CLONES.fieldNames()))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file and the byte-order line number in its file; files are numbered without gathering a whole file."""
    from ..operators.tables import positions

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return positions(lines, "file", ["block", "at"], "line").select("value", "file", "line")


def function_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """idx (text) and func of JSON lines; of a repeated idx the last line wins."""
    rows = numbered_lines(spark, path).select("file", "line", F.from_json("value", "idx string, func string").alias("r"))
    return rows.groupBy(F.col("r.idx").alias("idx")).agg(F.max_by("r.func", F.struct("file", "line")).alias("func"))


def pair_list(spark: SparkSession, path: str, split: str) -> DataFrame:
    """id1, id2, label of white-space separated lines with exactly three fields."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == 3)
    return rows.select(F.col("f")[0].alias("id1"), F.col("f")[1].alias("id2"), F.col("f")[2].alias("label"), F.lit(split).alias("split"))


def naive_csv(spark: SparkSession, path: str) -> DataFrame:
    """Clone metadata split at commas, without quoting; the first line is a header; rows under five fields drop."""
    rows = numbered_lines(spark, path).where("line > 1").select("line", F.split(F.trim("value"), ",").alias("f")).where(F.size("f") >= 5)
    return rows.select("line", *(F.col("f")[i].alias(c) for i, c in enumerate(CLONES.fieldNames())))


def whole_files(spark: SparkSession, folders: list[str], pattern: str = "*.java") -> DataFrame:
    """path, prompt (parent folder's parent name) and content of each file; missing folders are skipped. Empty files are
    listed on the driver, since Spark's sources give no row for them."""
    found = [f for f in folders if exists(spark, f)]
    if not found:
        return spark.createDataFrame([], "path string, prompt string, content string")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(found).select("path", "content")
    empty = [(x.getPath().toString(), bytearray()) for f in found for x in _glob(spark, f"{f}/{pattern}") if not x.getLen()]
    if empty:
        rows = rows.unionByName(spark.createDataFrame(empty, "path string, content binary"))
    return rows.select("path", F.element_at(F.split("path", "/"), -3).alias("prompt"), F.col("content").cast("string").alias("content"))


def strict_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = BALANCED) -> DataFrame:
    """Blank lines are skipped; bad JSON or a missing field raises when the rows are read. Each line is parsed once."""
    found = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(found.alias("m"))
    missing = F.array_except(F.array(*map(F.lit, schema.fieldNames())), F.map_keys("m"))
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))).cast("map<string,string>")).otherwise(F.col("m"))
    return rows.select(checked.alias("m")).select(*(F.col("m")[f.name].cast(f.dataType).alias(f.name) for f in schema))


def lenient_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = BALANCED) -> DataFrame:
    """Rows with bad JSON or a missing field are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "").withColumn("keys", F.json_object_keys("value"))
    whole = F.size(F.array_except(F.array(*map(F.lit, schema.fieldNames())), "keys")) == 0
    return raw.where(F.col("keys").isNotNull() & whole).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")


def silent_jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Existing files of a list as one relation; unreadable rows go, a missing class is UNKNOWN."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], BALANCED)
    rows = spark.read.text(found).where(F.json_object_keys("value").isNotNull()).select(F.from_json("value", BALANCED).alias("r")).select("r.*")
    return rows.withColumn("clone_type", F.coalesce("clone_type", F.lit("UNKNOWN")))


def class_scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line and class of each JSON line, without decoding it."""
    return numbered_lines(spark, paths).select("file", "line", last_clone_type(F.col("value")).alias("clone_type"))


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; built and written first when it does not exist."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def metrics_json(spark: SparkSession, path: str, default: dict) -> dict:
    """A metrics document, or the default when there is none."""
    if not exists(spark, path):
        return dict(default)
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def load_model(spark: SparkSession, path: str):
    """A stored pipeline model; raises FileNotFoundError when there is none."""
    from pyspark.ml import PipelineModel

    if not exists(spark, path):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)
