"""Queries of sources and sinks: files are written to the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import CLASSES, clone_type
from ..functions.vectors import pair_vector
from ..operators import metrics as met
from ..operators.sampling import undersample
from ..operators.tables import shared_folder
from ..schemas import BALANCED
from ..sources import readers, sinks


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/clonelens-io/{uuid.uuid4().hex}"


def _pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("text").alias("func1"), F.reverse("text").alias("func2"), F.concat(F.lit("T"), (F.col("turn") % 3).cast("string")).alias("clone_type"), F.col("conv_id").alias("n"))


def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lines, one in seven cut short and one in eleven without a field; good rows per class."""
    rows = _pair_rows(spark, sf_dir)
    whole, part = F.to_json(F.struct("func1", "func2", "clone_type")), F.to_json(F.struct("func1", "clone_type"))
    line = F.when(F.col("n") % 7 == 0, F.substring(whole, 1, 20)).when(F.col("n") % 11 == 0, part).otherwise(whole)
    path = _folder(spark)
    rows.select(line.alias("value")).write.text(path)
    return readers.lenient_jsonl(spark, path).groupBy("clone_type").agg(F.count(F.lit(1)).alias("n"))


def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, all whole, read strictly; rows per class."""
    path = _folder(spark)
    _pair_rows(spark, sf_dir).select(F.to_json(F.struct("func1", "func2", "clone_type")).alias("value")).write.text(path)
    return readers.strict_jsonl(spark, path, BALANCED).groupBy("clone_type").agg(F.count(F.lit(1)).alias("n"))


def class_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes found in raw lines without decoding, per class."""
    path = _folder(spark)
    _pair_rows(spark, sf_dir).select(F.to_json(F.struct("func1", "func2", "clone_type")).alias("value")).write.text(path)
    return readers.class_scan(spark, path).groupBy("clone_type").agg(F.count(F.lit(1)).alias("n"))


def function_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a JSON-lines dictionary, read back: idx and the text's length."""
    path = _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows.select(F.to_json(F.struct(F.col("doc_id").alias("idx"), F.col("text").alias("func"))).alias("value")).write.text(path)
    return readers.function_dictionary(spark, path).select("idx", F.length("func").cast("bigint").alias("n_chars"))


def jsonl_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified split written as one folder of JSON lines per split, counted after reading."""
    from .catalog import stratified_split

    path = _folder(spark)
    sinks.jsonl_by_split(stratified_split(spark, sf_dir), path)
    return spark.read.schema("doc_id bigint, lang string, split string").json(path).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


def pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs as white-space separated lines, one in nine with a fourth field; the others read back."""
    path = _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("n"), F.col("toxic").alias("t"))
    line = F.concat(F.lit("  "), F.col("n").cast("string"), F.lit("\t"), (F.col("n") + 1).cast("string"), F.lit("  "), F.col("t").cast("string"), F.when(F.col("n") % 9 == 0, " x").otherwise(" "))
    rows.select(line.alias("value")).write.text(path)
    return readers.pair_list(spark, path, "train")


def naive_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone metadata as text lines under a header, one in seven too short; the class of every pair that is left."""
    path = f"{_folder(spark)}/clones.csv"
    i = F.col("doc_id")
    cells = [i.cast("string"), (i + 1).cast("string"), (1 + i % 4).cast("string"), F.lit('"quoted"'), F.format_string("0.%02d", i % 100)]
    line = F.when(i % 7 == 0, F.concat_ws(",", *cells[:3])).otherwise(F.concat_ws(",", *cells))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(i, line.alias("value"))
    head = spark.sql("SELECT CAST(-1 AS BIGINT) AS doc_id, 'one,two,type,line,token' AS value")
    head.unionByName(rows).repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)  # one file: its first line is the header
    found = readers.naive_csv(spark, path)
    kind = clone_type(F.col("SYNTACTIC_TYPE"), F.col("SIMILARITY_TOKEN"))
    return found.select(F.col("FUNCTION_ID_ONE").alias("id1"), F.col("FUNCTION_ID_TWO").alias("id2"), F.col("SIMILARITY_LINE").alias("similarity_line"), kind.alias("clone_type"))


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files of two prompts (a third folder is absent, other endings are skipped), with their sizes."""
    from .flows import FILES

    folder = _folder(spark)
    for prompt, own in FILES.items():
        for k, content in enumerate(own):
            sinks.write_text(spark, f"{folder}/{prompt}/T4/{k:02}.java", content)
        sinks.write_text(spark, f"{folder}/{prompt}/T4/notes.txt", "skipped")
    rows = readers.whole_files(spark, [f"{folder}/{p}/T4" for p in (*FILES, "absent")])
    return rows.select("prompt", F.element_at(F.split("path", "/"), -1).alias("file"), F.length("content").alias("n_chars"))


def silent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files as one relation: one is absent, bad lines go, a missing class is UNKNOWN; rows per class."""
    rows, folder = _pair_rows(spark, sf_dir), _folder(spark)
    whole, part = F.to_json(F.struct("func1", "func2", "clone_type")), F.to_json(F.struct("func1", "func2"))
    rows.select(F.when(F.col("n") % 5 == 0, part).otherwise(whole).alias("value")).write.text(f"{folder}/train")
    rows.select(F.when(F.col("n") % 3 == 0, F.substring(whole, 1, 15)).otherwise(whole).alias("value")).write.text(f"{folder}/valid")
    found = readers.silent_jsonl(spark, [f"{folder}/train", f"{folder}/valid", f"{folder}/test"])
    return found.groupBy("clone_type").agg(F.count(F.lit(1)).alias("n"))


def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts as CSV with a header, read back; an empty table writes no file, which adds no row here."""
    folder = _folder(spark)
    counts = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("lang").alias("clone_type")).agg(F.count(F.lit(1)).alias("n"))
    sinks.csv_table(counts, f"{folder}/counts")
    sinks.csv_table(counts.where("n < 0"), f"{folder}/none")
    found = [p for p in (f"{folder}/counts", f"{folder}/none") if readers.exists(spark, p)]
    return spark.read.option("header", True).csv(found).select("clone_type", F.col("n").cast("bigint").alias("n"))


def _matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    from .catalog import predictions

    labels = list(CLASSES)
    return met.confusion(predictions(spark, sf_dir), labels), labels


def confusion_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled confusion matrix as a file, line by line."""
    matrix, labels = _matrix(spark, sf_dir)
    path = f"{_folder(spark)}/matrix.csv"
    sinks.confusion_csv(spark, met.confusion_wide(matrix, labels), labels, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classification report as text, line by line."""
    path = f"{_folder(spark)}/report.txt"
    sinks.write_text(spark, path, sinks.report_text(met.class_report(_matrix(spark, sf_dir)[0])))
    return spark.read.text(path).select(F.col("value").alias("line"))


def class_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-class table with four decimals as text."""
    path = _folder(spark)
    sinks.class_csv(met.class_report(_matrix(spark, sf_dir)[0]), path)
    return spark.read.option("header", True).csv(path)


def metrics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the binary evaluation as a JSON document, read back; an absent document gives its default."""
    from .catalog import binary_metrics_main

    path = f"{_folder(spark)}/metrics.json"
    row = binary_metrics_main(spark, sf_dir).first()
    sinks.json_document(spark, path, {c: row[c] for c in ("tp", "fp", "tn", "fn")})
    found = readers.metrics_json(spark, path, {}) | readers.metrics_json(spark, path + ".absent", {"default": -1})
    return spark.createDataFrame(list(found.items()), "metric string, n bigint")


def qa_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table lines of the Markdown report of class counts and sampled pairs."""
    path, rows = f"{_folder(spark)}/qa.md", _pair_rows(spark, sf_dir)
    counts = rows.groupBy("clone_type").agg(F.count(F.lit(1)).alias("n"))
    sample = undersample(rows.withColumn("id1", F.monotonically_increasing_id().cast("string")).withColumn("id2", F.col("id1")), "clone_type", "id1", 3)
    sinks.write_text(spark, path, sinks.qa_markdown(counts, sample.select("id1", "id2", "func1", "func2", "clone_type")))
    text = spark.read.text(path, wholetext=True)  # a sampled text may hold such a line: the table ends at the first section
    head = F.split(F.substring_index("value", "\n## ", 1), "\n")
    return text.select(F.explode(head).alias("line")).where(F.col("line").startswith("|"))


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair vectors built once, written, and read from the cache the second time."""
    from .catalog import rounded, vector_pairs

    path = _folder(spark)

    def build() -> DataFrame:
        return vector_pairs(spark, sf_dir, 1).select("id1", "id2", pair_vector(F.col("a"), F.col("b")).alias("features"))

    def never() -> DataFrame:
        raise AssertionError("the cache was not used")

    readers.cached(spark, path, build)
    rows = readers.cached(spark, path, never)
    return rounded(rows.select("id1", "id2", F.size("features").alias("width"), F.element_at("features", -1).alias("cosine")))


def tokenizer_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer's record, written and read back: entries and their sizes."""
    path = f"{_folder(spark)}/tokenizer.json"
    sinks.json_document(spark, path, sinks.tokenizer_record())
    return spark.createDataFrame([(k, len(v)) for k, v in readers.metrics_json(spark, path, {}).items()], "entry string, size int")


def jdbc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone metadata in a database, read through JDBC: NULL is the text ``null``. The database is an embedded one in a file of
    the shared folder, which must be mounted by all machines; ``readers.jdbc_clones`` takes any URL."""
    i = F.col("doc_id")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        i.cast("string").alias("FUNCTION_ID_ONE"), (i + 1).cast("string").alias("FUNCTION_ID_TWO"), (1 + i % 4).cast("string").alias("SYNTACTIC_TYPE"),
        F.lit(None).cast("int").alias("SIMILARITY_LINE"), F.format_string("0.%02d", i % 100).alias("SIMILARITY_TOKEN"), F.lit("more").alias("OTHER"),
    )
    columns = ", ".join(f"{c} {'VARCHAR(40)' if t == 'string' else 'INTEGER'}" for c, t in rows.dtypes)
    return readers.jdbc_clones(spark, sinks.derby_archive(rows, "CLONES", columns, _folder(spark)), driver=DERBY)


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"
_CLASS = "'T' || (turn % 3)"
_TYPED = "CASE 1 + doc_id % 4 WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN CASE WHEN doc_id % 100 >= 90 THEN 'VST3' WHEN doc_id % 100 >= 70 THEN 'ST3' WHEN doc_id % 100 >= 50 THEN 'MT3' ELSE 'WT3' END ELSE 'UNKNOWN' END"


def oracles() -> dict[str, str]:
    from . import catalog as cat
    from .flows import FILES

    reported = f"""WITH {cat.PRED}, {cat.GRID},
per AS (SELECT c AS class, (SELECT sum(n) FROM matrix WHERE actual = c) AS support, (SELECT sum(n) FROM matrix WHERE predicted = c) AS called, (SELECT sum(n) FROM matrix WHERE actual = c AND predicted = c) AS tp FROM (VALUES {cat.CLASS_VALUES}) v(c)),
pr AS (SELECT *, {cat._div('tp', 'called')} AS p, {cat._div('tp', 'support')} AS r FROM per), f AS (SELECT *, {cat._div('2 * p * r', 'p + r')} AS f FROM pr)"""
    files = ", ".join(f"('{p}', '{k:02}.java', {len(c)})" for p, own in FILES.items() for k, c in enumerate(own))
    record = ", ".join(f"('{k}', {len(v)})" for k, v in sinks.tokenizer_record().items())
    cells = ", ".join(f"sum(CASE WHEN predicted = '{c}' THEN n END)" for c in CLASSES)
    return {
        "jsonl_lenient": f"SELECT {_CLASS} AS clone_type, count(*) AS n FROM conversations WHERE conv_id % 7 <> 0 AND conv_id % 11 <> 0 GROUP BY 1",
        "jsonl_strict": f"SELECT {_CLASS} AS clone_type, count(*) AS n FROM conversations GROUP BY 1",
        "jsonl_class_scan": f"SELECT {_CLASS} AS clone_type, count(*) AS n FROM conversations GROUP BY 1",
        "function_dictionary": "SELECT CAST(doc_id AS VARCHAR) AS idx, length(text) AS n_chars FROM documents",
        "jsonl_by_split": f"WITH {cat.STRATIFIED} SELECT split, lang, count(*) AS n FROM split GROUP BY 1, 2",
        "pair_list": "SELECT CAST(doc_id AS VARCHAR) AS id1, CAST(doc_id + 1 AS VARCHAR) AS id2, CAST(toxic AS VARCHAR) AS label, 'train' AS split FROM labels WHERE doc_id % 9 <> 0",
        "naive_csv": f"SELECT CAST(doc_id AS VARCHAR) AS id1, CAST(doc_id + 1 AS VARCHAR) AS id2, '\"quoted\"' AS similarity_line, {_TYPED} AS clone_type FROM labels WHERE doc_id % 7 <> 0",
        "whole_files": f"SELECT p AS prompt, f AS file, CAST(n AS INTEGER) AS n_chars FROM (VALUES {files}) v(p, f, n)",
        "silent_files": f"SELECT c AS clone_type, count(*) AS n FROM (SELECT CASE WHEN conv_id % 5 = 0 THEN 'UNKNOWN' ELSE {_CLASS} END AS c FROM conversations UNION ALL SELECT {_CLASS} FROM conversations WHERE conv_id % 3 <> 0) GROUP BY 1",
        "csv_table": "SELECT lang AS clone_type, count(*) AS n FROM documents GROUP BY 1",
        "confusion_csv": f"WITH {cat.PRED}, {cat.GRID} SELECT 'actual\\predicted,{','.join(CLASSES)}' AS line UNION ALL SELECT concat_ws(',', actual, {cells}) FROM matrix GROUP BY actual",
        "report_lines": f"""{reported} SELECT format('{{:>20s}}{{:>12s}}{{:>12s}}{{:>12s}}{{:>12s}}', 'class', 'precision', 'recall', 'f1', 'support') AS line
UNION ALL SELECT printf('%20s%12.4f%12.4f%12.4f%12d', class, p, r, f, CAST(support AS BIGINT)) FROM f""",
        "class_csv": f"{reported} SELECT class, printf('%.4f', p) AS precision, printf('%.4f', r) AS recall, printf('%.4f', f) AS f1, CAST(support AS VARCHAR) AS support FROM f",
        "metrics_document": f"""WITH {cat.BINARY}, cells AS (SELECT {cat._cells_sql(cat.REVIEWED.format('t'), cat.REVIEWED.format('q'))} FROM b WHERE t IS NOT NULL)
SELECT unnest(['tp', 'fp', 'tn', 'fn', 'default']) AS metric, unnest([tp, fp, tn, fn, -1]) AS n FROM cells""",
        "qa_markdown": f"""WITH c AS (SELECT {_CLASS} AS k, count(*) AS n FROM conversations GROUP BY 1) SELECT unnest(['| class | pairs |', '| --- | --- |']) AS line
UNION ALL SELECT format('| {{}} | {{:,}} |', k, n) FROM c UNION ALL SELECT format('| total | {{:,}} |', CAST(sum(n) AS BIGINT)) FROM c""",
        "embedding_cache": f"WITH {cat.EMB} SELECT a.vec_id AS id1, b.vec_id AS id2, CAST(2 * len(a.e) + 1 AS INTEGER) AS width, round({cat.COSINE}, 6) AS cosine FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1",
        "tokenizer_record": f"SELECT e AS entry, CAST(n AS INTEGER) AS size FROM (VALUES {record}) v(e, n)",
        "jdbc_scan": "SELECT CAST(doc_id AS VARCHAR) AS FUNCTION_ID_ONE, CAST(doc_id + 1 AS VARCHAR) AS FUNCTION_ID_TWO, CAST(1 + doc_id % 4 AS VARCHAR) AS SYNTACTIC_TYPE, 'null' AS SIMILARITY_LINE, '0.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS SIMILARITY_TOKEN FROM labels",
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "jsonl_lenient": jsonl_lenient,
    "jsonl_strict": jsonl_strict,
    "jsonl_class_scan": class_scan,
    "function_dictionary": function_dictionary,
    "jsonl_by_split": jsonl_by_split,
    "pair_list": pair_list,
    "naive_csv": naive_csv,
    "whole_files": whole_files,
    "silent_files": silent_files,
    "csv_table": csv_table,
    "confusion_csv": confusion_csv,
    "report_lines": report_lines,
    "class_csv": class_csv,
    "metrics_document": metrics_document,
    "qa_markdown": qa_markdown,
    "embedding_cache": embedding_cache,
    "tokenizer_record": tokenizer_record,
    "jdbc_scan": jdbc_scan,
}
