"""Lexer, word tokens, splitting, vectors and syntax trees."""

import random

from pyspark.sql import functions as F

from clonelens.functions import java_tree, lexer, text, vectors
from clonelens.operators.pairs import overlap_features, token_counts


def lex(spark, *codes):
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, c string")
    return [r["t"] for r in rows.select("i", lexer.java_tokens(F.col("c")).alias("t")).orderBy("i").collect()]


def test_lexer_table(spark):
    got = lex(
        spark, 'int x = 0xFF + 1_000L; // note', 'String s = "a // b \\" c"; /* gone */ char c = \'\\\'\';', "1..2 .5 1.5e-3f 0b101", "a >>>= b -> c::d ... >> <<=", '"""\ntext "block"\n""" + x',
        '"never closed', "/* never closed", None, "", "é_ü$1 = #\\ 3;", '"' + "x" * 50_000 + '" y',
    )
    assert got[0] == ["int", "ID", "=", "NUM_LIT", "+", "NUM_LIT", ";"]
    assert got[1] == ["ID", "ID", "=", "STR_LIT", ";", "char", "ID", "=", "CHAR_LIT", ";"]
    assert got[2] == ["NUM_LIT", ".", "NUM_LIT", "NUM_LIT", "NUM_LIT", "NUM_LIT"]  # the second dot begins a number
    assert got[3] == ["ID", ">>>=", "ID", "->", "ID", "::", "ID", "...", ">>", "<<="]
    assert got[4] == ["STR_LIT", "+", "ID"]
    assert got[5:9] == [["STR_LIT"], [], [], []]
    assert got[9] == ["ID", "=", "NUM_LIT", ";"]
    assert got[10] == ["STR_LIT", "ID"]


def test_comment_stripping_keeps_newlines_and_literals(spark):
    row = spark.createDataFrame([('a // b\n/* c\nd */ e "// f"',)], "c string").select(lexer.strip_comments(F.col("c")).alias("s")).first()
    assert row["s"] == 'a     \n    \n     e "// f"'


def test_split_functions(spark):
    cases = {"a\n\nb": ("a", "b"), "a\n\nb\n\nc": ("a", "b\n\nc"), " one ": (" one ", " one "), "a\r\n\r\nb": ("a", "b"), "a\n \nb": ("a\n \nb", "a\n \nb"), "x\n\n  \n\ny": ("x", "y")}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", text.split_functions(F.col("c")).alias("h")).collect()
    assert {r["c"]: (r["h"]["func1"], r["h"]["func2"]) for r in rows} == cases


def test_overlap_properties(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = token_counts(docs, "id", text.words(F.col("text")))
    pairs = spark.createDataFrame([(a, b) for a in range(20) for b in range(20)], "id1 long, id2 long")
    got = {(r["id1"], r["id2"]): r for r in overlap_features(pairs, counts).collect()}
    assert len(got) == 400
    for (a, b), r in got.items():
        assert r["jaccard_similarity"] == got[b, a]["jaccard_similarity"] and r["containment_1_in_2"] == got[b, a]["containment_2_in_1"]
        assert r["shared_token_overlap"] <= min(r["tokens_func1"], r["tokens_func2"])
        assert a != b or r["overlap_similarity"] == (1.0 if texts[a].strip() else 0.0)


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    r = row.select(vectors.cosine(a, b).alias("c"), vectors.cosine(a, z).alias("cz"), vectors.euclidean(a, b).alias("e"), vectors.pair_vector(a, b, True).alias("v"), vectors.pair_vector(b, a, True).alias("w")).first()
    assert abs(r["c"] - 3 / (5**0.5 * 3)) < 1e-9 and r["cz"] == 0 and abs(r["e"] - 8**0.5) < 1e-12
    assert r["v"] == r["w"] and len(r["v"]) == 6


def test_tree_features():
    f = java_tree.features("int f(int a, String b) { if (a > 1) { return a; } for (;;) { g(b); } }")
    assert (f["parse_success"], f["n_MethodDeclaration"], f["n_IfStatement"], f["n_ForStatement"], f["n_ReturnStatement"], f["n_MethodInvocation"], f["n_parameters"]) == (1, 1, 1, 1, 1, 1, 2)
    assert f["ratio_control_flow"] == 2 / f["total_nodes"]
    assert set(java_tree.features("int f( {").values()) == {0.0}
    assert java_tree.features("A(int x) { this.x = x; }")["n_parameters"] == 0
    deep = "void f() { x = " + "(" * 3000 + "1" + ")" * 3000 + "; }"
    assert java_tree.features(deep)["parse_success"] == 0
