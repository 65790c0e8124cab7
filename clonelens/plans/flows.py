"""Whole flows over the driver tables: dataset build, lexical and hybrid pair vectors, token triage, comparison tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import java_tree
from ..functions import taxonomy as tax
from ..functions import text as txt
from ..functions import vectors as vec
from ..functions.lexer import java_tokens, strip_comments
from ..operators import metrics as met
from ..operators import pairs as prs
from ..operators import sampling as smp
from ..operators import tfidf as tfi
from ..operators.tables import shared_folder, shuffled, stored
from ..schemas import UNIFIED
from ..sources import readers, sinks
from . import catalog as cat
from .catalog import rounded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


# ---------------------------------------------------------------- dataset build

#: Contents of the whole-file source, by prompt: two halves and more, one block only, CRLF, blank blocks.
FILES = {
    "p1": ["int a;\n\nint b;", "one();", "a();\n\nb();\n\nc();", "x;\r\n\r\ny;", "  q;\n\n\n\n  r;  "],
    "p2": ["if (a) b();\n\nwhile (c) d();", "k;\n \nl;", "m;\n\nn;\n\no;\n\np;", "return;\n\nbreak;", "", "z;\n\nz;", "u;\n\nv;\n\nw;"],
}


def _halves(content: str) -> tuple[str, str]:
    text = content.replace("\r\n", "\n")
    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    if len(parts) < 2:
        return text, text
    half = len(parts) // 2
    return "\n\n".join(parts[:half]), "\n\n".join(parts[half:])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_T4 = [(prompt, *_halves(c)) for prompt, own in sorted(FILES.items()) for c in own]
T4_SQL = ", ".join(f"('GPT_T4_{p}_{i}_1', 'GPT_T4_{p}_{i}_2', {_quoted(a)}, {_quoted(b)})" for i, (p, a, b) in enumerate(_T4, 1))
UNIFY_SPLIT = cat.UNIFY.replace("CAST(toxic AS VARCHAR) AS label FROM labels", "CAST(toxic AS VARCHAR) AS label, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM labels")
DATASET = f"""{UNIFY_SPLIT},
known AS (SELECT split, p.id1, p.id2, coalesce(f.text, '') AS func1, coalesce(g.text, '') AS func2, CAST(label AS INTEGER) AS label,
  CASE WHEN label = '0' THEN 'T0' ELSE coalesce(cls, 'UNKNOWN_T123') END AS clone_type
  FROM pairs p LEFT JOIN typed t ON t.low = least(p.id1, p.id2) AND t.high = greatest(p.id1, p.id2)
  LEFT JOIN documents f ON CAST(f.doc_id AS VARCHAR) = p.id1 LEFT JOIN documents g ON CAST(g.doc_id AS VARCHAR) = p.id2),
t4 AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || a), a) AS rn, count(*) OVER () AS n FROM (VALUES {T4_SQL}) v(a, b, f, g)),
built AS (SELECT * FROM known UNION ALL SELECT {cat._cut_sql('n', 80, 90)}, a, b, f, g, 1, 'T4' FROM t4)"""


@query("dataset_build", f"WITH {DATASET}\nSELECT split, id1, id2, md5(func1) AS func1_md5, md5(func2) AS func2_md5, label, clone_type FROM built")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build from files: functions (JSON lines), pair lists per split, clone metadata (CSV) and whole files are
    read, united, graded, split, written as JSON lines per split and read back."""
    folder = f"{shared_folder(spark)}/clonelens-io/{uuid.uuid4().hex}"
    docs, (pairs, clones) = table(spark, sf_dir, "documents"), cat.labelled_relations(spark, sf_dir)
    docs.select(F.to_json(F.struct(F.col("doc_id").alias("idx"), F.col("text").alias("func"))).alias("value")).write.text(f"{folder}/functions")
    tenth = F.col("id1").cast("bigint") % 10
    lists = pairs.withColumn("split", F.when(tenth < 8, "train").when(tenth == 8, "valid").otherwise("test"))
    lists.select("split", F.concat_ws(" ", "id1", "id2", "label").alias("value")).write.partitionBy("split").text(f"{folder}/pairs")
    fields = ["FUNCTION_ID_ONE", "FUNCTION_ID_TWO", "SYNTACTIC_TYPE", F.lit("x"), "SIMILARITY_TOKEN"]
    clones.select("line", F.concat_ws(",", *fields).alias("value")).withColumn("line", F.col("line") + 1).unionByName(
        spark.sql("SELECT CAST(-1 AS BIGINT) AS line, 'a,b,c,d,e' AS value")
    ).repartitionByRange(1, "line").sortWithinPartitions("line").select("value").write.text(f"{folder}/clones")
    for prompt, own in FILES.items():
        for k, content in enumerate(own):
            sinks.write_text(spark, f"{folder}/{prompt}/T4/{k:02}.java", content)
    united = build_dataset(spark, f"{folder}/functions", {s: f"{folder}/pairs/split={s}" for s in ("train", "valid", "test")}, f"{folder}/clones", [f"{folder}/{p}/T4" for p in (*FILES, "absent")])
    sinks.jsonl_by_split(united.orderBy(shuffled("id1")), f"{folder}/out")
    back = spark.read.schema(T.StructType([*UNIFIED.fields, T.StructField("split", T.StringType())])).json(f"{folder}/out")
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")
    return back.select("split", "id1", "id2", digest("func1"), digest("func2"), "label", "clone_type")


def build_dataset(spark: SparkSession, functions: str, lists: dict[str, str], clones: str, folders: list[str]) -> DataFrame:
    """Unified records of all splits: labelled pairs keep the split of their list, contextual pairs are cut 80/10/10."""
    pairs = None
    for split, path in lists.items():
        own = readers.pair_list(spark, path, split)
        pairs = own if pairs is None else pairs.unionByName(own)
    known = prs.unify(pairs, readers.function_dictionary(spark, functions), readers.naive_csv(spark, clones))
    t4 = prs.contextual_pairs(readers.whole_files(spark, folders), ["prompt", "path"])
    return known.unionByName(smp.positional_split(t4, "id1"))


# ---------------------------------------------------------------- lexical and hybrid pair vectors, fitted on train

PAIR1 = """pos AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn FROM documents),
pair AS (SELECT a.doc_id AS id1, b.doc_id AS id2, CASE WHEN a.doc_id % 20 < 14 THEN 'train' WHEN a.doc_id % 20 < 17 THEN 'valid' ELSE 'test' END AS split
  FROM pos a JOIN pos b ON a.lang = b.lang AND b.rn = a.rn + 1)"""
FITTED = f"""{PAIR1},\n{cat.TOKENS},
side AS (SELECT id1 AS key FROM pair WHERE split = 'train' UNION ALL SELECT id2 FROM pair WHERE split = 'train'),
vocab AS (SELECT token AS term, CAST(sum(n) AS BIGINT) AS total, count(*) AS df FROM side JOIN tc USING (key) GROUP BY token ORDER BY 2 DESC, 1 LIMIT 1000),
idf AS (SELECT term, total, df, ln((1.0 + (SELECT count(*) FROM side)) / (1.0 + df)) + 1 AS idf FROM vocab),
raw AS (SELECT key, term, n * idf AS w FROM tc JOIN idf ON token = term), w AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM raw),
one AS (SELECT id1, id2, term, w AS x FROM pair JOIN w ON key = id1), two AS (SELECT id1, id2, term, w AS y FROM pair JOIN w ON key = id2),
lex AS (SELECT id1, id2, count(*) AS terms, sum(abs(coalesce(x, 0) - coalesce(y, 0))) AS d, sum(coalesce(x, 0) * coalesce(y, 0)) AS p,
  sum(coalesce(x, 0) * coalesce(y, 0)) / (sqrt(sum(coalesce(x, 0) * coalesce(x, 0))) * sqrt(sum(coalesce(y, 0) * coalesce(y, 0))) + 1e-9) AS c
  FROM one FULL JOIN two USING (id1, id2, term) GROUP BY id1, id2),
lexical AS (SELECT id1, id2, split, coalesce(terms, 0) AS terms, coalesce(d, 0.0) AS difference_sum, coalesce(p, 0.0) AS product_sum, coalesce(c, 0.0) AS cosine FROM pair LEFT JOIN lex USING (id1, id2))"""


def train_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    pairs = prs.neighbour_pairs(docs, "doc_id", "lang", ["n_chars", "doc_id"], reach=1)
    part = F.col("id1") % 20
    return docs, stored(pairs.withColumn("split", F.when(part < 14, "train").when(part < 17, "valid").otherwise("test")), "train-pairs")


def fitted_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, vocabulary with IDF (fitted on both sides of the train pairs), and the weights of all documents."""
    docs, pairs = train_pairs(spark, sf_dir)
    counts = stored(tfi.term_counts(docs, "doc_id", txt.words(F.col("text"))), "terms")
    idfs = stored(tfi.fit(counts, pairs.where("split = 'train'")), "idf")
    return pairs, idfs, stored(tfi.weights(counts, idfs), "weights")


def lexical_summary(vectors: DataFrame) -> list:
    """The blocks of a sparse lexical pair vector, summed: distinct terms, differences, products, cosine."""
    n = tfi.MAX_FEATURES
    part = lambda low, high: F.aggregate(F.filter(F.arrays_zip("indices", "values"), lambda x: (x["indices"] >= low) & (x["indices"] < high)), F.lit(0.0), lambda s, x: s + x["values"])
    terms = F.size(F.filter("indices", lambda i: i < n)).cast("bigint")
    return [terms.alias("terms"), part(0, n).alias("difference_sum"), part(n, 2 * n).alias("product_sum"), part(2 * n, 2 * n + 1).alias("cosine")]


@query("tfidf_idf_train", f"WITH {FITTED} SELECT term, total, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fitted_weights(spark, sf_dir)[1].select("term", "total", "df", "idf"))


@query("tfidf_pair_vectors", f"WITH {FITTED} SELECT id1, id2, split, CAST(2001 AS INTEGER) AS width, terms, {cat._round('difference_sum product_sum cosine', 5)} FROM lexical")
def tfidf_pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors of width 2,001 (differences, products, cosine) of neighbouring documents, by their block sums."""
    pairs, idfs, weighted = fitted_weights(spark, sf_dir)
    vectors = tfi.pair_vectors(pairs, weighted, idfs)
    return rounded(vectors.join(pairs, ["id1", "id2"]).select("id1", "id2", "split", "width", *lexical_summary(vectors)), 5)


# ---------------------------------------------------------------- syntax trees of generated methods

#: A method per document: so many if statements, loops and calls; one in ten lacks its end and does not parse.
IFS, LOOPS, CALLS, BROKEN = "doc_id % 4", "doc_id % 3", "n_chars % 5", "doc_id % 10 = 9"
#: Hand-counted nodes of each part. Frame: unit, class, method, 3 types, 2 parameters, return, reference. An if: the statement,
#: comparison, its 2 references, block, return, reference. A call: statement, invocation, reference. A loop: the statement,
#: control, declaration, type, declarator, literal, comparison, its 2 references, update, block, statement, assignment, 2 references.
FRAME_NODES, IF_NODES, LOOP_NODES, CALL_NODES = 10, 7, 15, 3
FRAME, IF, LOOP, CALL, END = "int m(int a, int b) { ", "if (a > b) { return a; } ", "for (int i = 0; i < b; i++) { a += i; } ", "g(a); ", "return b; }"
CODE_SQL = f"'{FRAME}' || repeat('{IF}', CAST(i AS INTEGER)) || repeat('{LOOP}', CAST(f AS INTEGER)) || repeat('{CALL}', CAST(c AS INTEGER)) || CASE WHEN bad THEN '' ELSE '{END}' END"
PARTS = f"parts AS (SELECT doc_id, {IFS} AS i, {LOOPS} AS f, {CALLS} AS c, {BROKEN} AS bad FROM documents)"
COUNTS = {
    "parse_success": "1", "total_nodes": f"{FRAME_NODES} + {IF_NODES} * i + {LOOP_NODES} * f + {CALL_NODES} * c",
    "max_depth": "CASE WHEN f > 0 THEN 8 WHEN i > 0 THEN 7 WHEN c > 0 THEN 6 ELSE 5 END",
    "n_MethodDeclaration": "1", "n_IfStatement": "i", "n_ForStatement": "f", "n_ReturnStatement": "1 + i", "n_MethodInvocation": "c", "n_VariableDeclarator": "f", "n_Assignment": "f",
    "n_BinaryOperation": "i + f", "n_Literal": "f", "n_MemberReference": "1 + 3 * i + 5 * f + c", "n_StatementExpression": "f + c", "n_BlockStatement": "i + f", "n_parameters": "2",
}


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the Java method made from a document's row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(IFS).alias("i"), F.expr(LOOPS).alias("f"), F.expr(CALLS).alias("c"), F.expr(BROKEN).alias("bad"))
    return docs.select("doc_id", F.expr(CODE_SQL).alias("code"))


RATIOS = {"ratio_control_flow": "n_IfStatement + n_ForStatement", "ratio_method_invocations": "n_MethodInvocation", "ratio_assignments": "n_Assignment", "ratio_returns": "n_ReturnStatement"}
_counted = ", ".join(f"CASE WHEN bad THEN 0.0 ELSE CAST({COUNTS.get(n, '0')} AS DOUBLE) END AS {n}" for n in java_tree.FEATURES if n not in RATIOS)
TREES = f"""{PARTS}, counted AS (SELECT doc_id, {_counted} FROM parts),
trees AS (SELECT *, {', '.join(f'CASE WHEN total_nodes = 0 THEN 0.0 ELSE ({e}) / total_nodes END AS {n}' for n, e in RATIOS.items())} FROM counted)"""


@query("ast_features", f"WITH {TREES} SELECT doc_id, {', '.join(f'round({n}, 6) AS {n}' for n in java_tree.FEATURES)} FROM trees")
def ast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 syntax-tree features of a generated method per document."""
    return rounded(generated(spark, sf_dir).select("doc_id", java_tree.tree_features(F.col("code")).alias("f")).select("doc_id", "f.*"))


@query("parse_success_rate", f"WITH {TREES} SELECT round(avg(parse_success), 6) AS parse_success_rate, count(*) AS n FROM trees")
def parse_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated(spark, sf_dir).select(java_tree.tree_features(F.col("code"))["parse_success"].alias("ok"))
    return rounded(rows.agg(F.avg("ok").alias("parse_success_rate"), F.count(F.lit(1)).alias("n")))


VECTORS = f"""{TREES}, v AS (SELECT doc_id, [{', '.join(java_tree.FEATURES)}] AS e FROM trees),
tree_pair AS (SELECT a.doc_id AS id1, b.doc_id AS id2, {cat.GAP} AS tree_gap, {cat.DOT} AS tree_product, {cat.COSINE} AS tree_cosine, {cat.DISTANCE} AS tree_distance
  FROM v a JOIN v b ON b.doc_id = a.doc_id + 1)"""
TREE_COLUMNS = "tree_gap tree_product tree_cosine tree_distance"


def tree_blocks(v) -> list:
    n = len(java_tree.FEATURES)
    return [vec.total(F.slice(v, 1, n)).alias("tree_gap"), vec.total(F.slice(v, n + 1, n)).alias("tree_product"), F.element_at(v, 2 * n + 1).alias("tree_cosine"), F.element_at(v, 2 * n + 2).alias("tree_distance")]


@query("ast_pair_vectors", f"WITH {VECTORS} SELECT id1, id2, CAST(58 AS INTEGER) AS width, {cat._round(TREE_COLUMNS)} FROM tree_pair")
def ast_pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax-tree pair vectors of width 58 of the methods of neighbouring documents, by their block sums."""
    rows = stored(generated(spark, sf_dir).select("doc_id", java_tree.tree_vector(F.col("code")).alias("v")), "trees")
    a, b = rows.select(F.col("doc_id").alias("id1"), F.col("v").alias("a")), rows.select((F.col("doc_id") - 1).alias("id1"), F.col("doc_id").alias("id2"), F.col("v").alias("b"))
    pairs = a.join(b, "id1").select("id1", "id2", vec.pair_vector(F.col("a"), F.col("b"), distance=True).alias("features"))
    return rounded(pairs.select("id1", "id2", F.size("features").alias("width"), *tree_blocks(F.col("features"))))


@query(
    "hybrid_pair_vectors",
    f"""WITH {FITTED}, {VECTORS.split('tree_pair AS')[0]}
tree_pair AS (SELECT id1, id2, {cat.GAP} AS tree_gap, {cat.DOT} AS tree_product, {cat.COSINE} AS tree_cosine, {cat.DISTANCE} AS tree_distance
  FROM pair JOIN v a ON a.doc_id = id1 JOIN v b ON b.doc_id = id2)
SELECT id1, id2, split, CAST(2059 AS INTEGER) AS width, terms, {cat._round('difference_sum product_sum cosine ' + TREE_COLUMNS, 5)} FROM lexical JOIN tree_pair USING (id1, id2)""",
)
def hybrid_pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical (2,001) and syntax-tree (58) pair vectors side by side, 2,059 wide, by their block sums."""
    pairs, idfs, weighted = fitted_weights(spark, sf_dir)
    trees = stored(generated(spark, sf_dir).select("doc_id", java_tree.tree_vector(F.col("code")).alias("v")), "trees")
    rows = tfi.pair_vectors(pairs, weighted, idfs).join(pairs, ["id1", "id2"])
    rows = rows.join(trees.select(F.col("doc_id").alias("id1"), F.col("v").alias("a")), "id1").join(trees.select(F.col("doc_id").alias("id2"), F.col("v").alias("b")), "id2")
    rows = tfi.with_dense(rows, vec.pair_vector(F.col("a"), F.col("b"), distance=True))
    behind = F.slice("values", F.size("values") - 2 * len(java_tree.FEATURES) - 1, 2 * len(java_tree.FEATURES) + 2)
    return rounded(rows.select("id1", "id2", "split", "width", *lexical_summary(rows), *tree_blocks(behind)), 5)


@query(
    "lexer_generated_java",
    f"""WITH {PARTS} SELECT doc_id, 'int ID ( int ID , int ID ) {{ ' || repeat('if ( ID > ID ) {{ return ID ; }} ', CAST(i AS INTEGER))
  || repeat('for ( int ID = NUM_LIT ; ID < ID ; ID ++ ) {{ ID += ID ; }} ', CAST(f AS INTEGER)) || repeat('ID ( ID ) ; ', CAST(c AS INTEGER))
  || CASE WHEN bad THEN '' ELSE 'return ID ; }}' END AS tokens FROM parts""",
)
def lexer_generated_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised tokens of the generated methods (a comment and strings are in the page texts of the other queries)."""
    rows = generated(spark, sf_dir).select("doc_id", "code", F.array_join(java_tokens(F.col("code")), " ").alias("tokens"))
    return rows.select("doc_id", F.when(F.col("code").endswith("}"), F.col("tokens")).otherwise(F.concat("tokens", F.lit(" "))).alias("tokens"))


@query("class_wrapper", f"WITH {PARTS} SELECT doc_id, md5('public class Dummy {{' || chr(10) || trim({CODE_SQL}) || chr(10) || '}}' || chr(10)) AS wrapped_md5 FROM parts")
def class_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir).select("doc_id", F.md5(txt.whole_class(F.col("code")).cast("binary")).alias("wrapped_md5"))


COMMENT_PIECES = "|".join([r"//[^\n]*", r"(?s:/\*.*?(?:\*/|\z))", r'(?s:""".*?(?:"""|\z))', r'"(?:[^"\\]|\\(?s:.))*(?:"|\\)?', r"''(?:[^''\\]|\\(?s:.))*(?:''|\\)?", r"[^/\"'']+", r"(?s:.)"])


@query(
    "comment_stripping",
    f"""SELECT page_id, md5(array_to_string(list_transform(regexp_extract_all(html, '{COMMENT_PIECES}'),
  lambda p: CASE WHEN starts_with(p, '//') OR starts_with(p, '/*') THEN regexp_replace(p, '[^\n]', ' ', 'g') ELSE p END), '')) AS stripped_md5 FROM pages""",
)
def comment_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(strip_comments(F.col("html")).cast("binary")).alias("stripped_md5"))


# ---------------------------------------------------------------- token triage

TRIAGE = f"""{cat.LEX_SQL}, tc AS (SELECT key, token, count(*) AS n FROM lexed GROUP BY ALL), tot AS (SELECT key, CAST(sum(n) AS BIGINT) AS total FROM tc GROUP BY key),
pair AS (SELECT a.page_id AS id1, b.page_id AS id2 FROM pages a JOIN pages b ON b.page_id = a.page_id + 1), {cat.OVERLAP},
scored AS (SELECT id1, id2, {cat._div('o', 'least(t1, t2)')} AS score, {cat.CLASS_LIST}[id1 % 8 + 1] AS clone_type, id1 % 3 AS part FROM feat),
main AS (SELECT *, {cat.TARGET.format('clone_type')} = 'review_required' AS t FROM scored WHERE clone_type <> 'T4'),
swept AS (SELECT threshold, {cat._cells_sql('t', '(score >= threshold)')} FROM main, (SELECT i / 100.0::DOUBLE AS threshold FROM range(101) r(i)) WHERE part = 1 GROUP BY threshold)"""


def _triage_sql() -> str:
    on_valid = cat.METRIC_SQL.replace("FROM cells)", "FROM swept)")
    keys = ", ".join(f"{k} DESC" for k in met.STRATEGIES["macro_f1"])
    chosen = f"chosen AS (SELECT threshold FROM metrics ORDER BY {keys} LIMIT 1)"
    tested = cat.METRIC_SQL.replace("rates AS", "rates2 AS").replace("FROM rates)", "FROM rates2)").replace("f1 AS (", "f12 AS (", 1).replace("metrics AS", "metrics2 AS").replace("FROM f1)", "FROM f12)").replace("FROM cells)", "FROM cells2)")
    return f"""WITH {TRIAGE}, {on_valid}, {chosen},
cells2 AS (SELECT {cat._cells_sql('t', '(score >= threshold)')} FROM main, chosen WHERE part = 2), {tested}
SELECT threshold, {', '.join(cat.CELL_NAMES.split())}, {cat._round(cat.METRICS)} FROM metrics2, chosen"""


@query("triage_flow", _triage_sql())
def triage_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token triage from end to end: lex, overlap, sweep on valid, choose the threshold, evaluate it on test once."""
    pages = table(spark, sf_dir, "pages")
    counts = stored(prs.token_counts(pages, "page_id", java_tokens(F.col("html"))), "page-tokens")
    ids = pages.select(F.col("page_id").alias("id2"))
    pairs = pages.select(F.col("page_id").alias("id1"), (F.col("page_id") + 1).alias("id2")).join(ids, "id2").select("id1", "id2")
    kind = F.element_at(F.array(*map(F.lit, tax.CLASSES)), (F.col("id1") % 8 + 1).cast("int"))
    scored = prs.overlap_features(pairs, counts).select("id1", F.col("overlap_similarity").alias("score"), tax.binary_target(kind).alias("binary_target"))
    scored = stored(scored.withColumn("part", F.col("id1") % 3), "scored")
    threshold = met.select_threshold(met.sweep(scored.where("part = 1"), "score"), "macro_f1").first()["threshold"]
    tested = scored.where("part = 2").withColumn("prediction", tax.predicted(F.col("score"), threshold))
    return cat.metric_columns(met.binary_metrics(tested).withColumn("threshold", F.lit(threshold)), "threshold")


# ---------------------------------------------------------------- error rows and comparison tables


@query(
    "false_positive_rows",
    f"""WITH {cat.EMB}, cand AS (SELECT a.vec_id AS id, a.label AS l1, b.label AS l2, b.vec_id AS id2, round({cat.COSINE}, 9) AS c FROM emb a JOIN emb b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 10),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, id2) = 1),
pred AS (SELECT id, id2, c, {cat.CLASS_LIST}[l1 % 8 + 1] AS actual, {cat.CLASS_LIST}[l2 % 8 + 1] AS predicted FROM best)
SELECT id, id2, actual, predicted, round(c, 6) AS cosine, substring(f.text, 1, 250) || '...' AS func1, substring(g.text, 1, 250) || '...' AS func2
FROM pred JOIN documents f ON f.doc_id = id JOIN documents g ON g.doc_id = id2 WHERE actual = 'T0' AND predicted <> 'T0'""",
)
def false_positive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives with excerpts of both texts and their cosine."""
    texts = table(spark, sf_dir, "documents").select("doc_id", txt.excerpt(F.col("text")).alias("excerpt"))
    rows = met.error_slices(cat.predictions(spark, sf_dir)).where("slice = 'false_positive'").drop("slice")
    one, two = texts.select(F.col("doc_id").alias("id"), F.col("excerpt").alias("func1")), texts.select(F.col("doc_id").alias("id2"), F.col("excerpt").alias("func2"))
    return rounded(rows.join(one, "id").join(two, "id2").select("id", "id2", "actual", "predicted", "cosine", "func1", "func2"))


def _class_rows_sql(model: str, reach: int) -> str:
    pred = cat.PRED.replace("a.vec_id + 10", f"a.vec_id + {reach}")
    return f"""SELECT '{model}' AS model, class, round(p, 6) AS precision, round(r, 6) AS recall, round({cat._div('2 * p * r', 'p + r')}, 6) AS f1, support FROM (
  WITH {pred}, {cat.GRID}
  SELECT c AS class, {cat._div('tp', 'called')} AS p, {cat._div('tp', 'support')} AS r, CAST(support AS BIGINT) AS support FROM (
    SELECT c, (SELECT sum(n) FROM matrix WHERE actual = c) AS support, (SELECT sum(n) FROM matrix WHERE predicted = c) AS called, (SELECT sum(n) FROM matrix WHERE actual = c AND predicted = c) AS tp FROM (VALUES {cat.CLASS_VALUES}) v(c)))"""


@query("comparison_by_class", _class_rows_sql("nearest_of_10", 10) + "\nUNION ALL " + _class_rows_sql("nearest_of_3", 3))
def comparison_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class rows of two models, one below the other."""
    from ..operators.models import class_rows

    reports = {m: met.class_report(met.confusion(cat.predictions(spark, sf_dir, k), list(tax.CLASSES))) for m, k in (("nearest_of_10", 10), ("nearest_of_3", 3))}
    return rounded(class_rows(reports))


@query("threshold_predictions", f"""WITH {cat.EMB}, s AS (SELECT a.vec_id AS id1, {cat.COSINE} AS score FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1)
SELECT id1, CASE WHEN round(score, 9) >= 0.05 THEN 'review_required' ELSE 'no_alert' END AS prediction FROM s""")
def threshold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.embedding_scores(spark, sf_dir).select("id1", tax.predicted(F.round("score", 9), 0.05).alias("prediction"))
