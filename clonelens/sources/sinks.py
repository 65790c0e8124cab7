"""Writers: CSV, JSON lines per split, JSON documents, confusion matrices, reports, models, label maps."""

from __future__ import annotations

import glob
import json
import os
import shutil
import tempfile
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import QA_ORDER, order_key


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document in whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def derby_archive(df: DataFrame, table: str, columns: str, path: str) -> str:
    """A table of an embedded database in one file, and the URL by which any number of processes read it at once; path is a
    folder that all machines mount. An embedded database belongs to the process that opens it, so tasks can't fill a
    common one: they write CSV, the driver's database imports it file by file on disk, and its files are stored without
    compression, which lets readers fetch a page by its place. columns: names and SQL types, in the order of df's."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        raise ValueError(f"embedded databases are read from mounted folders only: {path}")
    shared, own = p.toUri().getPath(), os.path.realpath(tempfile.mkdtemp())
    rows = f"{path}/rows"
    # the import drops white space around what is not quoted, and takes an empty field without quotes as NULL
    fields = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    df.select(F.concat_ws(",", *(F.coalesce(f, F.lit("")) for f in fields))).write.text(rows)
    jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    connect = jvm.java.sql.DriverManager.getConnection
    try:
        db = connect(f"jdbc:derby:{own}/db;create=true")
        try:
            db.createStatement().execute(f"CREATE TABLE {table} ({columns})")
            for part in sorted(glob.glob(f"{glob.escape(shared)}/rows/part-*.txt")):
                if os.path.getsize(part):
                    call = db.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
                    call.setString(1, table)
                    call.setString(2, part)
                    call.execute()
                    call.close()
        finally:
            db.close()
            try:
                connect(f"jdbc:derby:{own}/db;shutdown=true")
            except Py4JJavaError as e:
                if e.java_exception.getSQLState() != "08006":  # the state of a shutdown that went well
                    raise
        with zipfile.ZipFile(f"{shared}/db.jar", "w", zipfile.ZIP_STORED) as archive:
            for top, _, names in os.walk(f"{own}/db"):
                for name in names:
                    archive.write(f"{top}/{name}", os.path.relpath(f"{top}/{name}", own))
                    os.remove(f"{top}/{name}")
    finally:
        shutil.rmtree(own, ignore_errors=True)
        files.delete(jvm.org.apache.hadoop.fs.Path(rows), True)
    return f"jdbc:derby:jar:({shared}/db.jar)db"


def csv_table(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table writes nothing."""
    if not df.isEmpty():
        df.write.mode("overwrite").option("header", True).csv(path)


def jsonl_by_split(df: DataFrame, path: str) -> None:
    """JSON lines in one folder per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def json_document(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, json.dumps(document, indent=2, ensure_ascii=False))


def confusion_csv(spark: SparkSession, wide: DataFrame, labels: list[str], path: str) -> None:
    """Labelled matrix with the corner ``actual\\predicted``; rows in label order (a labels x labels table)."""
    rows = {r["actual"]: r for r in wide.collect()}
    lines = [",".join(["actual\\predicted", *labels])]
    lines += [",".join([a, *(str(rows[a][p] or 0) if a in rows else "0" for p in labels)]) for a in labels]
    write_text(spark, path, "\n".join(lines) + "\n")


def report_text(report: DataFrame) -> str:
    """Classification report as aligned text (one row per class)."""
    head = f"{'class':>20}{'precision':>12}{'recall':>12}{'f1':>12}{'support':>12}"
    return "\n".join([head, *(f"{r['class']:>20}{r['precision']:>12.4f}{r['recall']:>12.4f}{r['f1']:>12.4f}{r['support']:>12}" for r in report.collect())])


def class_csv(report: DataFrame, path: str) -> None:
    """Per-class table with four decimals as text."""
    four = [F.format_string("%.4f", c).alias(c) for c in ("precision", "recall", "f1")]
    csv_table(report.select("class", *four, "support"), path)


def qa_markdown(counts: DataFrame, samples: DataFrame) -> str:
    """Class counts with a grand total, then sampled pairs per class in preferred order."""
    rows = counts.orderBy("clone_type").collect()
    lines = ["# QA report", "", "| class | pairs |", "| --- | --- |", *(f"| {r['clone_type']} | {r['n']:,} |" for r in rows)]
    lines += [f"| total | {sum(r['n'] for r in rows):,} |", ""]
    last = None
    for r in samples.orderBy(order_key(F.col("clone_type"), QA_ORDER), "clone_type", "id1", "id2").collect():
        if r["clone_type"] != last:
            last = r["clone_type"]
            lines += [f"## {last}", ""]
        lines += [f"### {r['id1']} / {r['id2']}", "", "```java", (r["func1"] or "").strip(), "```", "", "```java", (r["func2"] or "").strip(), "```", ""]
    return "\n".join(lines)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def label_map(spark: SparkSession, labels: list[str], path: str) -> None:
    json_document(spark, path, {str(i): x for i, x in enumerate(labels)})


def tokenizer_record() -> dict:
    """What the lexer does, as a document."""
    from ..functions.lexer import KEYWORDS, OPERATORS, SINGLES

    return {"identifiers": "ID", "strings": "STR_LIT", "characters": "CHAR_LIT", "numbers": "NUM_LIT", "keywords": KEYWORDS, "operators": OPERATORS, "single_characters": SINGLES}
