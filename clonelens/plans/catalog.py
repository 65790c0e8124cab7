"""Queries of the reference's operators over whole driver tables, and DuckDB SQL for each.

The driver tables hold no clone pairs, so each operator runs on a stand-in: ``P`` pairs every document with the next
five of its language by length (copies are of nearly equal length, and the pairs stay linear in the documents).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy as tax
from ..functions import text as txt
from ..functions import vectors as vec
from ..functions.lexer import KEYWORDS, java_tokens
from ..operators import metrics as met
from ..operators import pairs as prs
from ..operators import sampling as smp
from ..operators import tfidf as tfi
from ..operators.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    from . import flows, io_plans, ml_plans

    return QUERIES | io_plans.QUERIES | ml_plans.QUERIES | flows.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import flows, io_plans, ml_plans

    return ORACLES | io_plans.oracles() | ml_plans.ORACLES | flows.ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _round(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


# ---------------------------------------------------------------- pairs of documents

PAIR = """pos AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn FROM documents),
pair AS (SELECT a.doc_id AS id1, b.doc_id AS id2 FROM pos a JOIN pos b ON a.lang = b.lang AND b.rn BETWEEN a.rn + 1 AND a.rn + 5)"""
TOKENS = r"""tc AS (SELECT doc_id AS key, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS token
  FROM documents) GROUP BY ALL),
tot AS (SELECT key, CAST(sum(n) AS BIGINT) AS total FROM tc GROUP BY key)"""
OVERLAP = """ov AS (SELECT id1, id2, CAST(sum(least(a.n, b.n)) AS BIGINT) AS o FROM pair JOIN tc a ON a.key = id1 JOIN tc b ON b.key = id2 AND a.token = b.token GROUP BY 1, 2),
feat AS (SELECT id1, id2, coalesce(x.total, 0) AS t1, coalesce(y.total, 0) AS t2, coalesce(o, 0) AS o FROM pair LEFT JOIN ov USING (id1, id2)
  LEFT JOIN tot x ON x.key = id1 LEFT JOIN tot y ON y.key = id2)"""


def _div(x: str, y: str) -> str:
    return f"CASE WHEN ({y}) = 0 THEN 0.0 ELSE CAST({x} AS DOUBLE) / ({y}) END"


MEASURES = f"""CAST(t1 AS BIGINT) AS tokens_func1, CAST(t2 AS BIGINT) AS tokens_func2, CAST(o AS BIGINT) AS shared_token_overlap,
round({_div('o', 'least(t1, t2)')}, 6) AS overlap_similarity, round({_div('o', 't1 + t2 - o')}, 6) AS jaccard_similarity,
round({_div('o', 't1')}, 6) AS containment_1_in_2, round({_div('o', 't2')}, 6) AS containment_2_in_1"""
GRADE = "CASE WHEN {0} IS NULL THEN 'UNKNOWN' WHEN isnan({0}) THEN 'WT3' WHEN {0} >= 0.9 THEN 'VST3' WHEN {0} >= 0.7 THEN 'ST3' WHEN {0} >= 0.5 THEN 'MT3' ELSE 'WT3' END"


def document_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return docs, prs.neighbour_pairs(docs, "doc_id", "lang", ["n_chars", "doc_id"])


def document_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pairs = document_pairs(spark, sf_dir)
    counts = stored(prs.token_counts(docs, "doc_id", txt.words(F.col("text"))), "token-counts")
    return prs.overlap_features(stored(pairs, "pairs"), counts)


@query("pair_overlap_features", f"WITH {PAIR},\n{TOKENS},\n{OVERLAP}\nSELECT id1, id2, {MEASURES} FROM feat")
def pair_overlap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(document_overlap(spark, sf_dir))


@query(
    "clone_grade_counts",
    f"""WITH {PAIR},\n{TOKENS},\n{OVERLAP},
g AS (SELECT {GRADE.format('j')} AS grade FROM (SELECT {_div('o', 't1 + t2 - o')} AS j FROM feat))
SELECT coalesce(grade, 'TOTAL') AS clone_type, count(*) AS n FROM g GROUP BY ROLLUP(grade)""",
)
def clone_grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = document_overlap(spark, sf_dir).select(tax.grade(F.col("jaccard_similarity")).alias("grade"))
    return graded.rollup("grade").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("grade", F.lit("TOTAL")).alias("clone_type"), "n")


CASES = [(t, s) for t in ("1", "2", "3", "4", "x") for s in ("0.95", "0.90", "0.8999", "0.70", "0.6999", "0.50", "0.4999", "0", "1", "null", "nan", "", "-1", "1e-1")]
CASE_VALUES = ", ".join(f"('{t}', '{s}')" for t, s in CASES)


@query(
    "clone_type_case",
    f"""SELECT t AS syntactic_type, s AS similarity, CASE t WHEN '1' THEN 'T1' WHEN '2' THEN 'T2' WHEN '3' THEN {GRADE.format('TRY_CAST(s AS DOUBLE)')} ELSE 'UNKNOWN' END AS clone_type
FROM (VALUES {CASE_VALUES}) v(t, s)""",
)
def clone_type_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {CASE_VALUES} AS v(syntactic_type, similarity)")
    return rows.withColumn("clone_type", tax.clone_type(F.col("syntactic_type"), F.col("similarity")))


@query(
    "exact_clone_groups",
    r"""SELECT min(doc_id) AS first_id, count(*) AS n, md5(k) AS text_key FROM (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS k FROM documents) GROUP BY k HAVING count(*) > 1""",
)
def exact_clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(txt.without_space(F.col("text")).cast("binary")).alias("text_key")
    return table(spark, sf_dir, "documents").groupBy(key).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_id", "n", "text_key")


# ---------------------------------------------------------------- lexer

RE2_TOKEN = "|".join([
    r"//[^\n]*", r"(?s:/\*.*?(?:\*/|\z))", r'(?s:""".*?(?:"""|\z))', r'"(?:[^"\\]|\\(?s:.))*(?:"|\\)?', r"''(?:[^''\\]|\\(?s:.))*(?:''|\\)?",
    r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?[fFdDlL]?", r"0[bB][01_]+[lL]?",
    r"\p{Nd}[\p{Nd}_]*(?:\.[\p{Nd}_]*)?(?:[eE][+-]?[\p{Nd}_]+)?[fFdDlL]?", r"\.\p{Nd}[\p{Nd}_]*(?:[eE][+-]?[\p{Nd}_]+)?[fFdD]?",
    r"[\p{L}_$][\p{L}\p{N}_$]*", r">>>=|<<=|>>=|\.\.\.|>>>|->|::|\+\+|--|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>", r"[{}()\[\];,.?:+\-*/%<>=!&|^~@]",
])
LEX_SQL = rf"""raw AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '([0-9])\.\.', '\1 ..', 'g'), '{RE2_TOKEN}')) AS m FROM pages),
lexed AS (SELECT page_id AS key, CASE WHEN m[1] = '"' THEN 'STR_LIT' WHEN m[1] = '''' THEN 'CHAR_LIT' WHEN regexp_matches(m, '^\.?\p{{Nd}}') THEN 'NUM_LIT'
  WHEN regexp_matches(m, '^[\p{{L}}_$]') THEN CASE WHEN m IN ({', '.join(repr(k) for k in KEYWORDS)}) THEN m ELSE 'ID' END ELSE m END AS token
  FROM raw WHERE NOT starts_with(m, '//') AND NOT starts_with(m, '/*'))"""


@query("lexer_token_classes", f"WITH {LEX_SQL}\nSELECT token, count(*) AS n FROM lexed GROUP BY token")
def lexer_token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.explode(java_tokens(F.col("html"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lexer_pair_overlap",
    f"""WITH {LEX_SQL}, tc AS (SELECT key, token, count(*) AS n FROM lexed GROUP BY ALL), tot AS (SELECT key, CAST(sum(n) AS BIGINT) AS total FROM tc GROUP BY key),
pair AS (SELECT a.page_id AS id1, b.page_id AS id2 FROM pages a JOIN pages b ON b.page_id = a.page_id + 1), {OVERLAP}
SELECT id1, id2, {MEASURES} FROM feat""",
)
def lexer_pair_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    counts = stored(prs.token_counts(pages, "page_id", java_tokens(F.col("html"))), "page-tokens")
    ids = pages.select(F.col("page_id").alias("id2"))
    pairs = pages.select(F.col("page_id").alias("id1"), (F.col("page_id") + 1).alias("id2")).join(ids, "id2").select("id1", "id2")
    return rounded(prs.overlap_features(pairs, counts))


# ---------------------------------------------------------------- taxonomy views

CLASS_VALUES = ", ".join(f"('{c}')" for c in tax.CLASSES)
TARGET = "CASE WHEN {0} = 'T0' THEN 'no_alert' WHEN {0} IN ('T1', 'T2', 'VST3', 'ST3', 'MT3', 'WT3') THEN 'review_required' END"


@query("binary_targets", f"SELECT c AS clone_type, {TARGET.format('c')} AS main_target, coalesce({TARGET.format('c')}, 'review_required') AS inclusive_target FROM (VALUES {CLASS_VALUES}) v(c)")
def binary_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {CLASS_VALUES} AS v(clone_type)")
    return rows.select("clone_type", tax.binary_target(F.col("clone_type")).alias("main_target"), tax.binary_target(F.col("clone_type"), True).alias("inclusive_target"))


@query(
    "product_category",
    f"SELECT c AS clone_type, CASE {' '.join(f'WHEN c = {k!r} THEN {v!r}' for k, v in tax.PRODUCT.items())} END AS category FROM (VALUES {CLASS_VALUES}) v(c)",
)
def product_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {CLASS_VALUES} AS v(clone_type)").select("clone_type", tax.product_category(F.col("clone_type")).alias("category"))


@query(
    "qa_order",
    f"""SELECT c AS clone_type, CASE c {' '.join(f'WHEN {c!r} THEN {i + 1}' for i, c in enumerate(tax.QA_ORDER))} ELSE {len(tax.QA_ORDER) + 1} END AS place
FROM (VALUES {CLASS_VALUES}, ('UNKNOWN')) v(c)""",
)
def qa_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {CLASS_VALUES}, ('UNKNOWN') AS v(clone_type)")
    return rows.select("clone_type", tax.order_key(F.col("clone_type"), tax.QA_ORDER).alias("place")).orderBy("place", "clone_type")


# ---------------------------------------------------------------- dataset unification

UNIFY = f"""pairs AS (SELECT CAST(doc_id AS VARCHAR) AS id1, CAST(doc_id + 1 AS VARCHAR) AS id2, CAST(toxic AS VARCHAR) AS label FROM labels),
clones AS (SELECT doc_id AS line, CAST(doc_id + 1 AS VARCHAR) AS a, CAST(doc_id - doc_id % 2 AS VARCHAR) AS b, CAST(1 + doc_id % 4 AS VARCHAR) AS st,
  '0.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS sim FROM labels),
wanted AS (SELECT DISTINCT least(id1, id2) AS low, greatest(id1, id2) AS high FROM pairs WHERE label = '1'),
kept AS (SELECT * FROM clones WHERE EXISTS (SELECT 1 FROM wanted WHERE low = least(a, b) AND high = greatest(a, b))),
typed AS (SELECT least(a, b) AS low, greatest(a, b) AS high,
  arg_max(CASE st WHEN '1' THEN 'T1' WHEN '2' THEN 'T2' WHEN '3' THEN {GRADE.format('TRY_CAST(sim AS DOUBLE)')} ELSE 'UNKNOWN' END, line) AS cls FROM kept GROUP BY 1, 2)"""


def labelled_relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels")
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    pairs = labels.select(s(i).alias("id1"), s(i + 1).alias("id2"), s(F.col("toxic")).alias("label"))
    clones = labels.select(
        i.alias("line"), s(i + 1).alias("FUNCTION_ID_ONE"), s(i - i % 2).alias("FUNCTION_ID_TWO"), s(1 + i % 4).alias("SYNTACTIC_TYPE"),
        F.concat(F.lit("0."), F.lpad(s(i % 100), 2, "0")).alias("SIMILARITY_TOKEN"),
    )
    return pairs, clones


@query(
    "unify_pairs_left",
    f"""WITH {UNIFY}
SELECT p.id1, p.id2, md5(coalesce(f.text, '')) AS func1_md5, md5(coalesce(g.text, '')) AS func2_md5, CAST(label AS INTEGER) AS label,
  CASE WHEN label = '0' THEN 'T0' ELSE coalesce(cls, 'UNKNOWN_T123') END AS clone_type
FROM pairs p LEFT JOIN typed t ON t.low = least(p.id1, p.id2) AND t.high = greatest(p.id1, p.id2)
LEFT JOIN documents f ON CAST(f.doc_id AS VARCHAR) = p.id1 LEFT JOIN documents g ON CAST(g.doc_id AS VARCHAR) = p.id2""",
)
def unify_pairs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, clones = labelled_relations(spark, sf_dir)
    functions = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("idx"), F.col("text").alias("func"))
    out = prs.unify(pairs, functions, clones)
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")
    return out.select("id1", "id2", digest("func1"), digest("func2"), "label", "clone_type")


@query("semi_join_reduce", f"WITH {UNIFY}\nSELECT line, a AS id_one, b AS id_two FROM kept")
def semi_join_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, clones = labelled_relations(spark, sf_dir)
    return prs.needed_clones(clones, pairs).select("line", F.col("FUNCTION_ID_ONE").alias("id_one"), F.col("FUNCTION_ID_TWO").alias("id_two"))



@query(
    "split_blank_line",
    r"""WITH c AS (SELECT conv_id, turn, replace(text, chr(10), chr(10) || chr(10)) AS t FROM conversations),
p AS (SELECT conv_id, turn, t, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS parts FROM c)
SELECT conv_id, turn, CASE WHEN len(parts) < 2 THEN t ELSE array_to_string(parts[1:len(parts) // 2], chr(10) || chr(10)) END AS func1,
  CASE WHEN len(parts) < 2 THEN t ELSE array_to_string(parts[len(parts) // 2 + 1:], chr(10) || chr(10)) END AS func2 FROM p""",
)
def split_blank_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", txt.split_functions(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("h"))
    return rows.select("conv_id", "turn", "h.func1", "h.func2")


# ---------------------------------------------------------------- counts, sampling, splits


@query("class_counts_rollup", "SELECT coalesce(lang, 'TOTAL') AS clone_type, count(*) AS n FROM documents GROUP BY ROLLUP(lang)")
def class_counts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").rollup("lang").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.coalesce("lang", F.lit("TOTAL")).alias("clone_type"), "n")


ORDERED = "md5('42:' || CAST(doc_id AS VARCHAR))"


def _cut_sql(n: str, a: int, b: int) -> str:
    return f"CASE WHEN 100 * rn <= {n} * {a} THEN 'train' WHEN 100 * rn <= {n} * {b} THEN 'valid' ELSE 'test' END"


STRATIFIED = f"""s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORDERED}, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents),
split AS (SELECT doc_id, lang, {_cut_sql('n', 70, 85)} AS split FROM s)"""


@query("stratified_split", f"WITH {STRATIFIED}\nSELECT * FROM split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smp.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("split_class_counts", f"WITH {STRATIFIED}\nSELECT split, lang AS clone_type, count(*) AS n FROM split GROUP BY 1, 2")
def split_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(spark, sf_dir).groupBy("split", F.col("lang").alias("clone_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "positional_split",
    f"WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY {ORDERED}, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, {_cut_sql('n', 80, 90)} AS split FROM s",
)
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smp.positional_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def _capped_sql(cap: int) -> str:
    return f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {ORDERED}, doc_id) <= {cap}"


@query("undersample_cap", _capped_sql(150))
def undersample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smp.undersample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 150)


@query("sample_k_per_class", _capped_sql(3))
def sample_k_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smp.undersample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 3)


@query("split_text_leakage", f"WITH {STRATIFIED}\nSELECT md5(text) AS text_md5, count(DISTINCT split) AS splits FROM split JOIN documents USING (doc_id) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_text_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return smp.split_leakage(smp.stratified_split(rows, "lang", "doc_id"), "text_md5")


# ---------------------------------------------------------------- TF-IDF

VOCAB = f"{TOKENS},\nvocab AS (SELECT token AS term, CAST(sum(n) AS BIGINT) AS total, count(*) AS df FROM tc GROUP BY token ORDER BY 2 DESC, 1 LIMIT 1000)"
IDF = f"{VOCAB},\nidf AS (SELECT term, total, df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1 AS idf FROM vocab)"
WEIGHT = f"{IDF},\nraw AS (SELECT key, term, n * idf AS w FROM tc JOIN idf ON token = term), w AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM raw)"


def document_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return docs, stored(tfi.term_counts(docs, "doc_id", txt.words(F.col("text"))), "terms")


@query("tfidf_vocab", f"WITH {VOCAB}\nSELECT * FROM vocab")
def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfi.vocabulary(document_terms(spark, sf_dir)[1])


@query("tfidf_idf", f"WITH {IDF}\nSELECT term, total, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, counts = document_terms(spark, sf_dir)
    return rounded(tfi.idf(tfi.vocabulary(counts), docs))


@query(
    "tfidf_cosine",
    f"""WITH {PAIR},\n{WEIGHT},
d AS (SELECT id1, id2, sum(a.w * b.w) AS dot FROM pair JOIN w a ON a.key = id1 JOIN w b ON b.key = id2 AND a.term = b.term GROUP BY 1, 2)
SELECT id1, id2, round(coalesce(dot, 0.0) / (1 + 1e-9), 6) AS cosine FROM pair LEFT JOIN d USING (id1, id2)""",
)
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, counts = document_terms(spark, sf_dir)
    weighted = stored(tfi.weights(counts, tfi.idf(tfi.vocabulary(counts), docs)), "weights")
    pairs = stored(prs.neighbour_pairs(docs, "doc_id", "lang", ["n_chars", "doc_id"]), "pairs")
    return rounded(tfi.pair_cosine(pairs, weighted))


# ---------------------------------------------------------------- embeddings: vector features, sweep, evaluation

EMB = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
DOT = "list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))"
NORM = "sqrt(list_sum(list_transform({0}.e, lambda x: x * x)))"
COSINE = f"{DOT} / ({NORM.format('a')} * {NORM.format('b')} + 1e-9)"
DISTANCE = "sqrt(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))))"
GAP = "list_sum(list_transform(range(1, len(a.e) + 1), lambda i: abs(a.e[i] - b.e[i])))"


def vector_pairs(spark: SparkSession, sf_dir: str, reach: int) -> DataFrame:
    """Vectors with their next ``reach`` ids: id1, id2, label1, label2, a, b."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label", vec.doubles(F.col("embedding")).alias("e"))
    left = emb.select(F.col("vec_id").alias("id1"), F.col("label").alias("label1"), F.col("e").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"))
    right = emb.select(F.col("vec_id").alias("id2"), F.col("label").alias("label2"), F.col("e").alias("b"))
    return left.withColumn("id2", F.col("id1") + F.col("k")).join(right, "id2").drop("k")


@query(
    "vector_pair_features",
    f"""WITH {EMB} SELECT a.vec_id AS id1, b.vec_id AS id2, round({GAP}, 6) AS abs_difference, round({DOT}, 6) AS product_sum, round({COSINE}, 6) AS cosine,
round({DISTANCE}, 6) AS euclidean, CAST(2 * len(a.e) + 2 AS INTEGER) AS width FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1""",
)
def vector_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = vector_pairs(spark, sf_dir, 1).select(
        "id1", "id2", vec.total(vec.abs_difference(a, b)).alias("abs_difference"), vec.total(vec.product(a, b)).alias("product_sum"),
        vec.cosine(a, b).alias("cosine"), vec.euclidean(a, b).alias("euclidean"), F.size(vec.pair_vector(a, b, distance=True)).alias("width"),
    )
    return rounded(rows)


METRICS = "accuracy precision_no_alert recall_no_alert f1_no_alert precision_review_required recall_review_required f1_review_required macro_f1 weighted_f1 balanced_accuracy false_positive_rate predicted_review_rate"
METRIC_SQL = f"""rates AS (SELECT *, tp + fp + tn + fn AS support, {_div('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_div('tn', 'tn + fn')} AS precision_no_alert,
  {_div('tn', 'tn + fp')} AS recall_no_alert, {_div('tp', 'tp + fp')} AS precision_review_required, {_div('tp', 'tp + fn')} AS recall_review_required,
  {_div('fp', 'fp + tn')} AS false_positive_rate, {_div('tp + fp', 'tp + fp + tn + fn')} AS predicted_review_rate FROM cells),
f1 AS (SELECT *, {_div('2 * precision_no_alert * recall_no_alert', 'precision_no_alert + recall_no_alert')} AS f1_no_alert,
  {_div('2 * precision_review_required * recall_review_required', 'precision_review_required + recall_review_required')} AS f1_review_required FROM rates),
metrics AS (SELECT *, (f1_no_alert + f1_review_required) / 2 AS macro_f1, {_div('f1_no_alert * (tn + fp) + f1_review_required * (tp + fn)', 'support')} AS weighted_f1,
  (recall_no_alert + recall_review_required) / 2 AS balanced_accuracy FROM f1)"""
CELLS = "CAST(sum(CASE WHEN {0} THEN 1 ELSE 0 END) AS BIGINT) AS {1}"


def _cells_sql(actual: str, predicted: str) -> str:
    parts = {"tp": f"{actual} AND {predicted}", "fp": f"NOT {actual} AND {predicted}", "tn": f"NOT {actual} AND NOT {predicted}", "fn": f"{actual} AND NOT {predicted}"}
    return ", ".join(CELLS.format(v, k) for k, v in parts.items())


SWEEP = f"""{EMB}, scored AS (SELECT {COSINE} AS score, a.label = b.label AS same FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1),
cells AS (SELECT threshold, {_cells_sql('same', '(score >= threshold)')} FROM scored, (SELECT i / 100.0::DOUBLE AS threshold FROM range(101) r(i)) GROUP BY threshold), {METRIC_SQL}"""
CELL_NAMES = "tp fp tn fn support"


def embedding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("label1") == F.col("label2"), tax.REVIEW).otherwise(tax.NO_ALERT)
    return vector_pairs(spark, sf_dir, 1).select("id1", vec.cosine(F.col("a"), F.col("b")).alias("score"), target.alias("binary_target"))


def metric_columns(df: DataFrame, *first: str) -> DataFrame:
    return rounded(df.select(*first, *CELL_NAMES.split(), *METRICS.split()))


@query("embedding_sweep", f"WITH {SWEEP}\nSELECT threshold, {', '.join(CELL_NAMES.split())}, {_round(METRICS)} FROM metrics")
def embedding_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_columns(met.sweep(embedding_scores(spark, sf_dir), "score"), "threshold")


def _select_sql(strategy: str) -> str:
    order = lambda s: ", ".join(f"{k} DESC" for k in met.STRATEGIES[s])
    columns = f"threshold, {', '.join(CELL_NAMES.split())}, {_round(METRICS)}"
    if strategy != "constrained_review_f1":
        return f"WITH {SWEEP}\nSELECT {columns}, '{strategy}' AS selected_by FROM (SELECT * FROM metrics ORDER BY {order(strategy)} LIMIT 1)"
    return f"""WITH {SWEEP}, met AS (SELECT *, '{strategy}' AS selected_by, 0 AS r FROM metrics WHERE recall_no_alert >= {met.LEAST_RECALL} ORDER BY {order(strategy)} LIMIT 1),
other AS (SELECT *, '{met.FALLBACK}' AS selected_by, 1 AS r FROM metrics ORDER BY {order('macro_f1')} LIMIT 1)
SELECT {columns}, selected_by FROM (SELECT * FROM met UNION ALL SELECT * FROM other ORDER BY r LIMIT 1)"""


def _selector(strategy: str) -> None:
    @query(f"threshold_select_{strategy}", _select_sql(strategy))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        swept = met.sweep(embedding_scores(spark, sf_dir), "score")
        best = met.select_threshold(swept, strategy)
        return metric_columns(best, "threshold", "selected_by").select("threshold", *CELL_NAMES.split(), *METRICS.split(), "selected_by")


for _strategy in met.STRATEGIES:
    _selector(_strategy)

CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in tax.CLASSES) + "]"
PRED = f"""{EMB}, cand AS (SELECT a.vec_id AS id, a.label AS l1, b.label AS l2, b.vec_id AS id2, round({COSINE}, 9) AS c FROM emb a JOIN emb b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 10),
best AS (SELECT id, l1, l2 FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, id2) = 1),
pred AS (SELECT id, {CLASS_LIST}[l1 % 8 + 1] AS actual, {CLASS_LIST}[l2 % 8 + 1] AS predicted FROM best)"""


def predictions(spark: SparkSession, sf_dir: str, reach: int = 10) -> DataFrame:
    """Class of the most similar of the next ``reach`` vectors as the prediction (the last vector has none): id, actual,
    predicted, id2, cosine."""
    rows = vector_pairs(spark, sf_dir, reach).select("id1", "id2", "label1", "label2", F.round(vec.cosine(F.col("a"), F.col("b")), 9).alias("c"))
    best = rows.groupBy(F.col("id1").alias("id")).agg(F.max(F.struct("c", (-F.col("id2")).alias("near"), "label1", "label2")).alias("x"))
    name = lambda c: F.element_at(F.array(*map(F.lit, tax.CLASSES)), (F.col(c) % 8 + 1).cast("int"))
    return best.select("id", name("x.label1").alias("actual"), name("x.label2").alias("predicted"), (-F.col("x.near")).alias("id2"), F.col("x.c").alias("cosine"))


def targets() -> dict[str, Column]:
    return {c: tax.binary_target(F.col(c)) for c in ("actual", "predicted")}


GRID = f"grid AS (SELECT a.c AS actual, p.c AS predicted FROM (VALUES {CLASS_VALUES}) a(c), (VALUES {CLASS_VALUES}) p(c)),\nmatrix AS (SELECT g.actual, g.predicted, count(pred.id) AS n FROM grid g LEFT JOIN pred USING (actual, predicted) GROUP BY 1, 2)"


@query("confusion_matrix", f"WITH {PRED},\n{GRID}\nSELECT actual, " + ", ".join(f"CAST(sum(CASE WHEN predicted = '{c}' THEN n END) AS BIGINT) AS {c}" for c in tax.CLASSES) + " FROM matrix GROUP BY actual")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = list(tax.CLASSES)
    return met.confusion_wide(met.confusion(predictions(spark, sf_dir), labels), labels)


@query(
    "multiclass_report",
    f"""WITH {PRED},\n{GRID},
per AS (SELECT c AS class, (SELECT sum(n) FROM matrix WHERE actual = c) AS support, (SELECT sum(n) FROM matrix WHERE predicted = c) AS called, (SELECT sum(n) FROM matrix WHERE actual = c AND predicted = c) AS tp
  FROM (VALUES {CLASS_VALUES}) v(c)),
pr AS (SELECT *, {_div('tp', 'called')} AS p, {_div('tp', 'support')} AS r FROM per), f AS (SELECT *, {_div('2 * p * r', 'p + r')} AS f FROM pr)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
)
def multiclass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.multiclass_report(met.confusion(predictions(spark, sf_dir), list(tax.CLASSES))))


BINARY = f"{PRED},\nb AS (SELECT *, {TARGET.format('actual')} AS t, CASE WHEN predicted = 'T0' THEN 'no_alert' ELSE 'review_required' END AS q, {TARGET.format('predicted')} AS strict FROM pred)"
REVIEWED = "({0} = 'review_required')"


@query("binary_metrics_main", f"WITH {BINARY}, cells AS (SELECT {_cells_sql(REVIEWED.format('t'), REVIEWED.format('q'))} FROM b WHERE t IS NOT NULL), {METRIC_SQL}\nSELECT {', '.join(CELL_NAMES.split())}, {_round(METRICS)} FROM metrics")
def binary_metrics_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select(tax.binary_target(F.col("actual")).alias("binary_target"), F.when(F.col("predicted") == "T0", tax.NO_ALERT).otherwise(tax.REVIEW).alias("prediction"))
    return metric_columns(met.binary_metrics(rows))


@query(
    "binary_metrics_strict",
    f"WITH {BINARY}, cells AS (SELECT {_cells_sql(REVIEWED.format('t'), REVIEWED.format('strict'))} FROM b WHERE t IS NOT NULL AND strict IS NOT NULL), {METRIC_SQL}\nSELECT {', '.join(CELL_NAMES.split())}, {_round(METRICS)} FROM metrics",
)
def binary_metrics_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets()
    rows = met.main_rows(predictions(spark, sf_dir)).select(t["actual"].alias("binary_target"), t["predicted"].alias("prediction"))
    return metric_columns(met.binary_metrics(rows))


@query(
    "prediction_rows",
    f"""WITH {BINARY} SELECT id, actual, predicted, coalesce(t, 'contextual_t4') AS binary_label, coalesce(strict, 'contextual_t4') AS predicted_binary,
t IS NULL OR strict IS NULL AS excluded_from_main_eval, CASE WHEN t IS NOT NULL AND strict IS NOT NULL THEN t = strict END AS correct_binary FROM b""",
)
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return met.prediction_rows(predictions(spark, sf_dir).drop("id2", "cosine"), targets())


REPORTED = ", ".join(f"({i}, '{c}')" for i, c in enumerate(tax.REPORT_ORDER))


@query(
    "per_class_review_rate",
    f"""WITH {BINARY}, n AS (SELECT actual, count(*) AS s, sum(CASE WHEN q = 'review_required' THEN 1 ELSE 0 END) AS p FROM b GROUP BY actual)
SELECT CAST(i AS INTEGER) AS place, c AS original_class, CAST(coalesce(s, 0) AS BIGINT) AS support, CAST(coalesce(p, 0) AS BIGINT) AS predicted_review_required,
round({_div('coalesce(p, 0)', 'coalesce(s, 0)')}, 6) AS recall_as_review_required FROM (VALUES {REPORTED}) v(i, c) LEFT JOIN n ON actual = c""",
)
def per_class_review_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("prediction", F.when(F.col("predicted") == "T0", tax.NO_ALERT).otherwise(tax.REVIEW))
    return rounded(met.review_rates(rows, cls="actual"))


@query(
    "contextual_report",
    f"""WITH {BINARY} SELECT count(*) AS support, CAST(sum(CASE WHEN q = 'review_required' THEN 1 ELSE 0 END) AS BIGINT) AS predicted_review_required,
round(avg(CASE WHEN q = 'review_required' THEN 1.0 ELSE 0.0 END), 6) AS review_required_rate, 'T4 is outside the main binary comparison and reported beside it.' AS note FROM b WHERE actual = 'T4'""",
)
def contextual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("prediction", F.when(F.col("predicted") == "T0", tax.NO_ALERT).otherwise(tax.REVIEW))
    return rounded(met.contextual_report(rows, cls="actual"))


@query(
    "error_slices",
    f"""WITH {PRED}, e AS (SELECT *, CASE WHEN actual = 'T0' AND predicted <> 'T0' THEN 'false_positive' WHEN actual <> 'T0' AND predicted = 'T0' THEN 'false_negative' END AS slice FROM pred)
SELECT id, actual, predicted, slice, substring(text, 1, 250) || '...' AS excerpt FROM e JOIN documents ON doc_id = id WHERE slice IS NOT NULL""",
)
def error_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), txt.excerpt(F.col("text")).alias("excerpt"))
    return met.error_slices(predictions(spark, sf_dir).drop("id2", "cosine")).join(texts, "id")


@query("error_counts", f"WITH {PRED} SELECT sum(CASE WHEN actual = 'T0' AND predicted <> 'T0' THEN 1 ELSE 0 END)::BIGINT AS false_positives, sum(CASE WHEN actual <> 'T0' AND predicted = 'T0' THEN 1 ELSE 0 END)::BIGINT AS false_negatives, sum(CASE WHEN actual = 'T0' THEN 1 ELSE 0 END)::BIGINT AS t0_rows FROM pred")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = F.col("actual") == "T0", F.col("predicted") == "T0"
    return predictions(spark, sf_dir).agg(F.count_if(a & ~p).alias("false_positives"), F.count_if(~a & p).alias("false_negatives"), F.count_if(a).alias("t0_rows"))


@query(
    "model_comparison",
    f"""WITH {PRED}, acc AS (SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS a FROM pred)
SELECT * FROM (VALUES ('tfidf', 0.8454::DOUBLE, 0.8730::DOUBLE, 0.8449::DOUBLE), ('ast', 0.77736, 0.76095, 0.77712)) v(model, accuracy, macro_f1, weighted_f1)
UNION ALL SELECT 'neighbour', round(a, 6), NULL, NULL FROM acc""",
)
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.models import comparison

    own = predictions(spark, sf_dir).agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))
    return rounded(comparison(own.select(F.lit("neighbour").alias("model"), "accuracy")))
