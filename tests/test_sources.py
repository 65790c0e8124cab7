"""Readers, sinks, unification, models and streams."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from clonelens.operators import models, pairs, tfidf
from clonelens.operators.tables import positions
from clonelens.sources import readers, sinks
from clonelens.streaming import scoring


def write(path, text):
    path.write_text(text)
    return str(path)


def test_jsonl_policies(spark, tmp_path):
    good = json.dumps({"func1": "a", "func2": "b", "clone_type": "T1"})
    bad = write(tmp_path / "bad.jsonl", f"{good}\n\n{good[:10]}\n" + json.dumps({"func1": "a"}) + "\n")
    assert readers.lenient_jsonl(spark, bad).count() == 1
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, bad).collect()
    assert readers.strict_jsonl(spark, write(tmp_path / "good.jsonl", good + "\n\n" + good + "\n")).count() == 2
    both = readers.silent_jsonl(spark, [bad, str(tmp_path / "absent")])
    assert {r["clone_type"] for r in both.collect()} == {"T1", "UNKNOWN"}
    assert [r["clone_type"] for r in readers.class_scan(spark, bad).orderBy("line").collect()][:1] == ["T1"]


def test_text_sources(spark, tmp_path):
    p = write(tmp_path / "pairs.txt", "1 2 1\n3  4\t0\nbad line\n\n")
    assert [tuple(r) for r in readers.pair_list(spark, p, "train").orderBy("id1").collect()] == [("1", "2", "1", "train"), ("3", "4", "0", "train")]
    c = write(tmp_path / "clones.csv", "h,h,h,h,h\n1,2,1,x,0.5\n1,2,3,x,0.95\nshort,row\n")
    rows = readers.naive_csv(spark, c)
    assert rows.count() == 2
    assert pairs.typed_pairs(rows, "line").first()["cls"] == "VST3"  # the last line wins
    d = write(tmp_path / "f.jsonl", '{"idx": 1, "func": "old"}\n{"idx": "1", "func": "new"}\n')
    assert [tuple(r) for r in readers.function_dictionary(spark, d).collect()] == [("1", "new")]
    (tmp_path / "p1" / "T4").mkdir(parents=True)
    write(tmp_path / "p1" / "T4" / "a.java", "x\n\ny")
    write(tmp_path / "p1" / "T4" / "a.txt", "no")
    files = readers.whole_files(spark, [str(tmp_path / "p1" / "T4"), str(tmp_path / "none")])
    out = pairs.contextual_pairs(files, ["prompt", "path"]).collect()
    assert [(r["id1"], r["func1"], r["func2"], r["clone_type"]) for r in out] == [("GPT_T4_p1_1_1", "x", "y", "T4")]


def test_unify(spark):
    clones = spark.createDataFrame([(1, "b", "a", "1", "x", "null"), (2, "c", "d", "3", "x", "0.70"), (3, "e", "f", "3", "x", "nan")], "line long, FUNCTION_ID_ONE string, FUNCTION_ID_TWO string, SYNTACTIC_TYPE string, SIMILARITY_LINE string, SIMILARITY_TOKEN string")
    rows = spark.createDataFrame([("a", "b", "1"), ("c", "d", "1"), ("e", "f", "1"), ("x", "y", "1"), ("a", "c", "0")], "id1 string, id2 string, label string")
    functions = spark.createDataFrame([("a", "A"), ("b", "B")], "idx string, func string")
    got = {r["id1"] + r["id2"]: (r["func1"], r["func2"], r["label"], r["clone_type"]) for r in pairs.unify(rows, functions, clones).collect()}
    assert got == {"ab": ("A", "B", 1, "T1"), "cd": ("", "", 1, "ST3"), "ef": ("", "", 1, "WT3"), "xy": ("", "", 1, "UNKNOWN_T123"), "ac": ("A", "", 0, "T0")}


def test_positions_number_every_row_once(spark):
    rows = spark.range(0, 500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 501).alias("k"))
    got = positions(rows, "g", ["k"]).collect()
    for g in range(3):
        own = sorted((r["k"], r["position"]) for r in got if r["g"] == g)
        assert [p for _, p in own] == list(range(1, len(own) + 1))
        assert {r["position_of"] for r in got if r["g"] == g} == {len(own)}
    assert positions(rows.limit(0), "g", ["k"]).count() == 0


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([("T0", 0.5, 0.25, 1 / 3, 4)], "class string, precision double, recall double, f1 double, support long")
    sinks.class_csv(report, str(tmp_path / "c"))
    assert "T0,0.5000,0.2500,0.3333,4" in spark.read.text(str(tmp_path / "c")).agg(F.concat_ws("|", F.collect_list("value"))).first()[0]
    assert "0.3333" in sinks.report_text(report)
    sinks.csv_table(report.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    wide = spark.createDataFrame([("a", 1, 2)], "actual string, a long, b long")
    sinks.confusion_csv(spark, wide, ["a", "b"], str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_text() == "actual\\predicted,a,b\na,1,2\nb,0,0\n"
    sinks.json_document(spark, str(tmp_path / "x.json"), {"a": 1})
    assert readers.metrics_json(spark, str(tmp_path / "x.json"), {}) == {"a": 1} and readers.metrics_json(spark, str(tmp_path / "y.json"), {"d": 2}) == {"d": 2}
    counts = spark.createDataFrame([("T0", 3), ("WT3", 1)], "clone_type string, n long")
    sample = spark.createDataFrame([("1", "2", "f", "g", "WT3"), ("3", "4", "h", "i", "T0")], "id1 string, id2 string, func1 string, func2 string, clone_type string")
    page = sinks.qa_markdown(counts, sample)
    assert "| total | 4 |" in page and page.index("## T0") < page.index("## WT3")
    assert len(sinks.tokenizer_record()["operators"]) == 25


def test_derby_archive(spark, tmp_path):
    rows = [("1", None, "more"), ('a "q", b\nx', 2, ""), (None, 3, " spaced "), ("\\N", -4, "é")]
    frame = spark.createDataFrame(rows, "A string, B int, C string").repartition(7)
    url = sinks.derby_archive(frame, "T", "A VARCHAR(40), B INTEGER, C VARCHAR(40)", f"file://{tmp_path}/db")
    found = spark.read.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.jdbc.EmbeddedDriver").load()
    assert found.columns == ["A", "B", "C"] and sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)
    assert os.listdir(tmp_path / "db") == ["db.jar"]
    empty = sinks.derby_archive(frame.limit(0), "T", "A VARCHAR(40), B INTEGER, C VARCHAR(40)", f"{tmp_path}/none")
    assert spark.read.format("jdbc").options(url=empty, dbtable="T", driver="org.apache.derby.jdbc.EmbeddedDriver").load().count() == 0
    with pytest.raises(Exception):  # a value that is too long is no row less
        sinks.derby_archive(frame, "T", "A VARCHAR(2), B INTEGER, C VARCHAR(40)", f"{tmp_path}/short")


def test_jdbc_scan_with_executors_of_their_own(spark, tmp_path):
    spark.range(0, 300, numPartitions=3).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "labels.parquet"))
    home = tmp_path / "home"  # executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
from pyspark.sql import SparkSession
conf = {{"spark.master": "local-cluster[2,1,600]", "spark.executor.memory": "500m", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from clonelens.plans.io_plans import jdbc_scan
found = jdbc_scan(spark, "{tmp_path}")
rows = found.union(found).repartition(4).collect()
print("rows", len(rows), len(set(rows)), sorted(rows)[0])
spark.stop()
"""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": here}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "rows 600 300 Row(FUNCTION_ID_ONE='0', FUNCTION_ID_TWO='1', SYNTACTIC_TYPE='1', SIMILARITY_LINE='null', SIMILARITY_TOKEN='0.00')" in done.stdout, done.stderr[-3000:]


def test_models_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([([float(i % 2), float(i % 3)], "T1" if i % 2 else "T0", i) for i in range(60)], "v array<double>, cls string, id long")
    data = models.labelled(rows, F.col("v"), "cls")
    model = models.fit(data, kind="forest", trees=5, depth=3)
    sinks.save_model(model, str(tmp_path / "m"))
    out = models.predict(readers.load_model(spark, str(tmp_path / "m")), data)
    assert out.where("actual = predicted").count() == 60 and models.class_labels(model) == ["T0", "T1"]
    with pytest.raises(FileNotFoundError):
        readers.load_model(spark, str(tmp_path / "absent"))


def test_boosting_stops_early_and_decides_by_margin(spark):
    rows = spark.createDataFrame([([float(i % 3), float(i % 2)], f"T{i % 3}", i) for i in range(240)], "v array<double>, cls string, id long")
    data = models.labelled(rows, F.col("v"), "cls")
    model = models.fit_boosted(data.where("id % 4 <> 0"), data.where("id % 4 = 0"), rounds=12, depth=3)
    assert model.labels == ["T0", "T1", "T2"] and all(len(m.trees) <= 12 for m in model.models)
    out = model.predict(data)
    assert out.columns == ["v", "id", "actual", "predicted"] and out.where("actual = predicted").count() == 240


def test_sparse_pair_vectors(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 4), (3, "z", 1)], "key long, term string, n long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "id1 long, id2 long")
    idfs = tfidf.fit(counts, pairs.where("id1 = 1"), size=3)
    assert [tuple(r)[:3] for r in idfs.orderBy("at").collect()] == [("a", 2, 1), ("b", 2, 2), ("c", 4, 1)]
    got = {r["id1"]: r for r in tfidf.pair_vectors(pairs, tfidf.weights(counts, idfs), idfs, size=3).collect()}
    assert [r["width"] for r in got.values()] == [7] * 3 and got[1]["indices"] == [0, 1, 2, 4, 6]
    x, y = got[1]["values"][0], got[1]["values"][2]
    assert x > 0 and y > 0 and got[1]["values"][4] == pytest.approx(got[1]["values"][3]) and got[3]["values"] == [0.0] and got[2]["indices"][-1] == 6


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from clonelens.operators import tables

    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(tables, "_checkpoint_dir", lambda _: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(spark)


def test_stream_scoring(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("int a = 1;", "int b = 2;"), ("x();", "return;")], "func1 string, func2 string").write.parquet(str(source))
    stream = spark.readStream.schema("func1 string, func2 string").parquet(str(source))
    q = scoring.score_stream(stream, 0.9).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = {r["func1"]: (r["overlap_similarity"], r["prediction"]) for r in spark.sql("select * from scored").collect()}
    assert got["int a = 1;"] == (1.0, "review_required") and got["x();"][1] == "no_alert"
