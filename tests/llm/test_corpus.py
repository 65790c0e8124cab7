"""Corpus operators: n-gram join, repeats and the pipeline, against brute force, with skew and edge cases."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clonelens.llm import common, ngram_join, packing, repeats
from clonelens.llm.ngram_join import Join

from .suffix_array import corpus_suffix_array
from .test_rows import DOCS, EDGE, WORDS, docs


# ---------------------------------------------------------------- connected components


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e} | {x: got[x] for x in got if find(x) == got[x]}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_raise_when_not_settled(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        common.components(chain, max_rounds=2)
    assert common.components(chain).where("root <> 0").count() == 0


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """The same rows as by rounds; up to DIRECT_EDGES edges with a few jobs, whatever the number of shuffle partitions."""
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(5000 - i, 4999 - i) for i in range(700)] + [(9000, 9001 + i) for i in range(300)] + [(7, 7), (9000, 9001), (-3, 1 << 60)]
    frame = spark.createDataFrame(edges, "a long, b long")
    wanted = sorted(map(tuple, common.components(frame).collect()))
    tracker = spark.sparkContext.statusTracker()

    def jobs(make):
        before = set(tracker.getJobIdsForGroup())
        out = make()
        return out, len(set(tracker.getJobIdsForGroup()) - before)

    got, n = jobs(lambda: common.classes(frame))
    assert sorted(map(tuple, got.collect())) == wanted and n <= 5
    assert common.classes(spark.createDataFrame([], "a long, b long")).count() == 0
    monkeypatch.setattr(common, "DIRECT_EDGES", 100)
    got, more = jobs(lambda: common.classes(frame))
    assert sorted(map(tuple, got.collect())) == wanted and more > n


def test_join_settles_few_edges_on_the_driver(spark, monkeypatch):
    """Near copies: the join's classes take no rounds of jobs, and are those that rounds give."""
    rng, rounds = random.Random(11), []
    plain = common.components
    monkeypatch.setattr(common, "components", lambda *a, **b: rounds.append(1) or plain(*a, **b))
    monkeypatch.setattr(ngram_join, "components", common.components, raising=False)
    rows = list(enumerate(t for _ in range(4) for t in family(rng, 60, 8, 3)))
    report = lambda: {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.component_report(docs(spark, [t for _, t in rows])).collect()}
    got = report()
    assert not rounds and got == plain_components(rows, Join())
    monkeypatch.setattr(common, "DIRECT_EDGES", 0)
    assert report() == got and rounds


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(spark)


def test_tables_belong_to_the_call_that_wrote_them(spark, tmp_path):
    taken = packing.pack_documents(docs(spark, ["one two", "three", None]))
    near = ngram_join.component_report(docs(spark, ["a b c d e", "a b c d e", "x"]))
    folder = tmp_path / "sf"
    docs(spark, ["some words of a text that are more than ten of them in number"] * 3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, "q")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).count() == 1
    assert taken.count() == 3 and near.count() == 3


# ---------------------------------------------------------------- n-gram join


def plain_set(text, n):
    words = [w.lower() for w in common.space_words(text)]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def plain_components(rows, join):
    sets = {i: plain_set(t, join.words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and join.den * both >= join.num * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, size, copies, edits):
    base = [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(size)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = f"edit{rng.random()}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("join", [Join(), Join(5, 80, 100), Join(1, 50, 100)])
@pytest.mark.parametrize("least", [2, 10_000])
def test_join_against_brute_force(spark, monkeypatch, join, least):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", least)
    rng = random.Random(11)
    passage = " ".join(f"common{i}" for i in range(25))
    texts = [t for size in (4, 30, 90, 200) for t in family(rng, size, 14, max(1, size // 12))]
    texts += [f"{' '.join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))} {passage}" for _ in range(25)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(20)] + EDGE + ["A B", "a  b", "Éa b c", "éa b c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("node", F.lit("clash")).withColumn("prefix", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.component_report(frame, join).collect()}
    assert got == plain_components(rows, join)


def test_group_of_copies_and_empty_table(spark):
    texts = ["the very same words again and again here"] * 400 + [f"other text number {i} with words of its own kind" for i in range(50)]
    got = [r["component_id"] for r in ngram_join.component_report(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0] * 400 + list(range(400, 450))
    assert ngram_join.component_report(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in ngram_join.component_report(docs(spark, ["", None])).orderBy("doc_id").collect()] == [0, 1]


def test_rows_follow_the_size_of_a_family_with_shared_edits(spark, monkeypatch):
    """Near copies whose edits come from a small pool, and a shingle that all texts hold: rows about double with the texts."""
    plain, counts = ngram_join.materialise, {}

    def counted(df, name):
        out = plain(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    told = {}
    for n in (1000, 2000):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(120)]
        pool = [(rng.randrange(3, 120), f"edit{k}") for k in range(60)]
        texts = []
        for _ in range(n):
            own = list(base)
            for at, word in rng.sample(pool, rng.randint(0, 6)):
                own[at] = word
            texts.append(" ".join(own))
        texts += ["w0 w1 w2 " + " ".join(f"other{rng.random()}" for _ in range(30)) for _ in range(n)]
        counts.clear()
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.component_report(docs(spark, texts)).collect()}
        told[n] = dict(counts)
        assert len({got[i] for i in range(n, 2 * n)}) == n
    print("ROWS", told)
    for name, k in told[2000].items():
        assert k <= 2.7 * told[1000][name] + 200, (name, told)


def test_one_per_class_keeps_columns_and_tells_rows_apart(spark):
    same = "one two three four five six seven"
    rows = [(5, same), (5, same), (5, "another text under the same number"), (3, same + " "), (9, None), (9, None), (None, same), (2, "alone in its class for good")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("near_id", F.lit("clash"))
    kept = ngram_join.one_per_class(frame, Join(5, 80, 100))
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(2, "alone in its class for good"), (3, same + " "), (5, "another text under the same number"), (9, ""), (9, "")]


# ---------------------------------------------------------------- repeats


def repeated_bytes(data, depth, wanted=None):
    """Per text, a mask of the bytes that repeated strings cover; ``wanted`` keeps some of the places only."""
    seen = {}
    keys = [[hashlib.md5(d[s : s + depth]).digest() for s in range(len(d) - depth + 1)] for d in data]
    for own in keys:
        for k in own:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, own in zip(data, keys):
        edge = np.zeros(len(d) + 1, dtype=np.int64)
        for s, k in enumerate(own):
            if seen[k] > 1:
                edge[s] += 1
                edge[s + depth] -= 1
        out.append(np.cumsum(edge)[:-1] > 0)
    return out


def runs(on):
    return int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())


def plain_repeats(texts, depth):
    data = [(t or "").encode() for t in texts]
    return [(len(d), int(on.sum()), runs(on), hashlib.sha256(np.frombuffer(d, dtype=np.uint8)[~on].tobytes()).hexdigest()) for d, on in zip(data, repeated_bytes(data, depth))]


def letters(rng, n, alphabet="abcdefghijklmnop "):
    return "".join(rng.choices(alphabet, k=n))


def repeat_texts(rng):
    passage = letters(rng, 1500, "abcdefgh é")
    texts = [letters(rng, rng.randint(0, 900)) + passage[(a := rng.randint(0, 1000)) : a + rng.randint(100, 700)] + letters(rng, rng.randint(0, 500)) for _ in range(40)]
    texts += [passage, passage, letters(rng, 300) + passage + passage, "a" * 900, "a" * 400, "ab" * 600, "x" * 399, letters(rng, 400), letters(rng, 401)]
    return texts + [t for t in EDGE if t is None or len(t) < 1000]


@pytest.mark.parametrize("passage", [200, 0])
def test_repeats_against_brute_force(spark, passage):
    texts = repeat_texts(random.Random(12))
    rows = docs(spark, texts, True).withColumns({"repeat_key": F.lit(1), "repeat_spans": F.lit("clash"), "_span_key": F.lit(2)})
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeat_report(rows, passage=passage).collect()}
    assert [got[i][:4] for i in range(len(texts))] == plain_repeats(texts, 400)
    data = [(t or "").encode() for t in texts]
    covered = repeated_bytes(data, 200)
    for i, on in enumerate(covered):  # passages are repeated strings, and every long one holds one
        n, size = got[i][4:]
        assert size <= on.sum() and (n > 0) == (size > 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
        if passage and any(b - a >= 200 + 128 + 15 for a, b in zip(edges[::2], edges[1::2])):
            assert n > 0
        assert passage or n == 0


def test_slices_give_the_parse_of_the_whole(monkeypatch):
    how = repeats.Parsing(passage=200)
    for t in repeat_texts(random.Random(12)):
        data = (t or "").encode()
        monkeypatch.setattr(repeats, "SLICE", 1 << 20)
        whole = repeats.parse_slice(np.frombuffer(data, dtype=np.uint8), how)
        monkeypatch.setattr(repeats, "SLICE", 300)
        parts = [repeats.parse_slice(x, how) for _, x in repeats.slices(data, how)]
        if whole is None:
            assert not parts
            continue
        assert (np.concatenate([np.repeat(p.counted, p.last - p.first + 1) for p in parts]) == np.repeat(whole.counted, whole.last - whole.first + 1)).all()
        size = lambda p: int(np.maximum(p.ends() - p.first + 1, 0).sum())
        assert sum(map(size, parts)) == size(whole) == max(0, len(data) - 399)


def test_repeats_in_a_text_of_many_slices(spark):
    rng = random.Random(21)
    passage = letters(rng, 700)
    long = letters(rng, (1 << 20) - 350) + passage + letters(rng, 90_000) + passage[100:] + letters(rng, 1000)
    texts = [long, letters(rng, 500) + passage[:450], letters(rng, 3000), None]
    got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.repeat_report(docs(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == plain_repeats(texts, 400) and got[0][1] == 700 + 600


def test_one_context_of_ten_thousand_entries(spark):
    rng = random.Random(22)
    common = letters(rng, 250)
    texts = [letters(rng, 110) + common + letters(rng, 110) for _ in range(10_000)]
    texts += [texts[5][:460] + "xyz", "q" + texts[7][20:]]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeat_report(docs(spark, texts)).collect()}
    assert [got[i][:4] for i in range(len(texts))] == plain_repeats(texts, 400)
    assert {i for i, r in got.items() if r[1]} == {5, 7, 10_000, 10_001}


def test_repeats_edges(spark):
    assert repeats.repeat_report(docs(spark, [])).count() == 0
    rows = repeats.repeat_report(docs(spark, [None, "", "short"])).orderBy("doc_id").collect()
    assert [tuple(r)[1:4] for r in rows] == [(0, 0, 0), (0, 0, 0), (5, 0, 0)]
    frame = docs(spark, ["é" * 300, "é" * 300, "keep me"], True).withColumn("repeat_key", F.lit(1)).withColumn("REPEAT_SPANS", F.lit(1))
    cut = repeats.without_repeats(frame)
    assert cut.columns == frame.columns and [r["text"] for r in cut.orderBy("doc_id").collect()] == ["", "", "keep me"]
    null_ids = spark.createDataFrame([(None, "z" * 450), (None, "z" * 450), (1, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0), r["n_removed"]) for r in repeats.repeat_report(null_ids).collect()) == [(0, 450), (0, 450), (1, 0)]


def test_a_phrase_divided_by_slices_is_no_passage(spark):
    text = letters(random.Random(16), 2_300_000)
    assert [tuple(r)[1:4] + tuple(r)[5:] for r in repeats.repeat_report(docs(spark, [text])).collect()] == [(len(text), 0, 0, 0, 0)]


def test_report_runs_one_python_function_per_stage(spark):
    texts = repeat_texts(random.Random(15))

    def functions(node, found):
        """Of the stage that node ends; those of the stages below go to found."""
        below = node.children()
        own = max((functions(below.apply(i), found) for i in range(below.size())), default=0) + (node.nodeName() == "MapInArrow")
        found.append(own)
        return 0 if "Exchange" in node.nodeName() else own

    for frame in (repeats.repeat_report(docs(spark, texts)), repeats.without_repeats(docs(spark, texts, True))):
        functions(frame._jdf.queryExecution().executedPlan().initialPlan(), found := [])
        assert max(found) == 1


def test_a_worker_holds_little_of_a_large_text():
    data = np.random.default_rng(3).integers(97, 122, 3_000_000, dtype=np.uint8).tobytes()
    tracemalloc.start()
    try:
        assert sum(len(repeats.parse_slice(x).counted) for _, x in repeats.slices(data)) > 10_000
        assert tracemalloc.get_traced_memory()[1] < 30_000_000
    finally:
        tracemalloc.stop()


def test_spans_are_what_the_suffix_array_says(spark):
    rng = random.Random(13)
    passage = "".join(rng.choice("ab") for _ in range(300))
    texts = [passage[rng.randint(0, 100) :][:180] + letters(rng, 60, "abc") for _ in range(12)] + ["", "a", "ababab" * 30]
    data = [t.encode() for t in texts]
    order = corpus_suffix_array(data)
    assert [data[t][p:] for t, p in order] == sorted(t[p:] for t in data for p in range(len(t)))
    depth = 100
    on = [np.zeros(len(t), dtype=bool) for t in data]
    for (a, p), (b, q) in zip(order, order[1:]):  # neighbours in corpus order with a common prefix of depth
        if len(data[a]) - p >= depth and data[a][p : p + depth] == data[b][q : q + depth]:
            on[a][p : p + depth] = on[b][q : q + depth] = True
    got = {bytes(r["doc_key"]): r["spans"] for r in repeats.repeated_spans(docs(spark, texts), repeats.Parsing(depth, 32))[0].collect()}
    for t, mask in zip(data, on):
        kept, spans = repeats.cut(t, got.get(hashlib.md5(t).digest()))
        assert (len(t) - len(kept), len(spans)) == (int(mask.sum()), runs(mask))


# ---------------------------------------------------------------- pipeline


def test_pipeline_takes_effect_and_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(14)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)) + "."
    passage, item = prose(90), prose(25)
    texts = [prose(120) for _ in range(40)]
    texts += [texts[0], texts[1] + " more"]  # 40, 41: near duplicates
    texts += [prose(60) + " " + passage + " " + prose(60) for _ in range(3)]  # 42-44: repeated passage
    texts += [prose(50) + " " + item + " " + prose(50)]  # 45: leak
    texts += ["junk %%% " * 40, "too short", None]  # 46-48
    folder = tmp_path / "sf"
    docs(spark, texts).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    frame, kept = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(folder)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in frame.collect()}
        if name != "packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["quality_rules"]) == set(range(46))
    assert set(kept["near_duplicates"]) == set(range(40)) | {42, 43, 44, 45}
    cut = kept["repeated_passages"]
    assert all(passage not in cut[i]["text"] for i in (42, 43, 44)) and all(cut[i]["text"] == texts[i] for i in range(40))
    assert all(cut[i]["n_chars"] == len(cut[i]["text"]) for i in cut)
    assert set(kept["benchmark_leaks"]) == set(range(40)) | {42, 43, 44} == set(kept["packing"])
    assert corpus_pipeline.run(spark, str(folder)).select("doc_id").distinct().count() == 43


def test_pipeline_of_empty_tables_and_clashing_columns(spark, tmp_path):
    folder = tmp_path / "sf"
    clash = ["near_id", "near_key", "quality_kept", "repeat_key", "repeat_spans", "span_key", "class", "node", "doc_key", "slot", "spans"]
    rng = random.Random(51)
    text = " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(60))
    for rows in (docs(spark, []), docs(spark, [text, text, None, ""])):
        rows = rows.withColumns({c: F.lit(1) for c in clash})
        rows.write.mode("overwrite").parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(str(folder / "benchmark.parquet"))
        frame = spark.read.parquet(str(folder / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, frame, str(folder)).write.mode("overwrite").parquet(str(tmp_path / name))
            frame = spark.read.parquet(str(tmp_path / name))
            assert frame.columns == rows.columns
        n = frame.count()
        assert n == (1 if rows.count() else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(folder)).count() == n


def test_stages_against_plain_versions_on_skewed_rows(spark, tmp_path):
    """Near duplicates and repeated passages on a table of which a third is one family and a fifth one text."""
    rng = random.Random(52)
    texts = family(rng, 60, 70, 5) + [" ".join(rng.choice(WORDS) for _ in range(40))] * 40 + [t for _ in range(30) for t in family(rng, 45, 3, 2)]
    passage = letters(rng, 420)
    texts += [letters(rng, 300) + passage[rng.randint(0, 100) :] + letters(rng, 50) for _ in range(20)] + [None, ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    classes = plain_components(list(enumerate(texts)), corpus_pipeline.NEAR)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (n, root) in classes.items() if root == i or not n}
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, frame, "").collect()}
    data = [(t or "").encode() for t in texts]
    for i, on in enumerate(repeated_bytes(data, corpus_pipeline.PASSAGE_BYTES)):
        assert (cut[i] or "") == np.frombuffer(data[i], dtype=np.uint8)[~on].tobytes().decode("utf-8", "ignore")
