"""Row-local operators: toxicity, HTML, URLs, WARC, licenses, quality, packing, against plain versions and edge cases."""

import base64
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clonelens.llm import common, html_text, license_scan, packing, quality, toxicity, url_filter, warc
from clonelens.llm import decontamination as dec

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def docs(spark, texts, extra=False):
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return rows.withColumn("n_words", F.lit("clash")).withColumn("spans", F.lit(1)) if extra else rows


EDGE = [None, "", " \n\t ", "one", "é" * 5, "same text here", "same text here", "x" * 30_000, "a\x00b \u2028 c"]


# ---------------------------------------------------------------- toxicity


def brute_segments(scores):
    """All maximal scoring segments by definition: best proper segment, then both sides, until nothing positive is left."""
    out = []

    def split(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(scores[i:j])
                if s > 1e-9 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                    best = (s, i, j)
        if best:
            split(a, best[1])
            out.append((best[1], best[2], best[0]))
            split(best[2], b)

    split(0, len(scores))
    return out


def test_maximal_segments_against_definition():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 25)
        weights = [rng.choice([0.0, 0.0, 0.0, 3.7, 1.9, -1.3]) for _ in range(n)]
        at = [i for i, w in enumerate(weights) if w]
        got = toxicity.maximal_segments([weights[i] - 0.53 for i in at], at, 0.53)
        want = brute_segments([w - 0.53 for w in weights])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_lambda_solves_its_equation():
    scores, counts = np.array([4.0, 2.0, -1.0, -0.5]), np.array([10, 100, 1000, 8890])
    x = toxicity.fit_lambda(scores, counts)
    assert x > 0 and abs((counts / counts.sum() * np.exp(x * scores)).sum() - 1) < 1e-6
    assert toxicity.fit_lambda(np.array([-1.0, -0.5]), np.array([1, 5])) == toxicity.MOST_LAMBDA


def test_e_values_hold_on_clean_texts():
    """Of random clean texts, about as many hold segments of E <= e as their E-values say."""
    rng = np.random.default_rng(3)
    scores = np.array([-0.5, -1.1, 0.37, 1.3, 2.9])
    p = np.array([0.87, 0.05, 0.05, 0.025, 0.005])
    lam = toxicity.fit_lambda(scores, p * 1e6)

    def found(texts, n):
        out = []
        for _ in range(texts):
            s = rng.choice(scores, n, p=p)
            at = [int(i) for i in np.flatnonzero(s != -0.5)]
            out.append([x for *_, x in toxicity.maximal_segments([float(s[i]) for i in at], at, 0.5)])
        return out

    k = toxicity.fit_k(np.concatenate(found(1500, 300)), 1500 * 300, lam)
    fresh = np.concatenate(found(3000, 200))
    for e in (1.0, 0.3, 0.1, 0.03):
        assert 0.5 < (k * 200 * np.exp(-lam * fresh) <= e).sum() / (3000 * e) < 2


def test_the_fit_solves_the_equation_on_the_clean_tokens(spark):
    rng = random.Random(17)
    texts = [" ".join([rng.choice(WORDS) for _ in range(60)] + ["awful"] * (i % 4 == 0) + ["grim"] * (i % 4 == 0 or i % 9 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts), labels)
    train = {r["doc_id"] for r in labels.where(~toxicity.held_out("doc_id")).collect()}
    scorer = toxicity.Scorer(model)
    own = np.array([w - model.drift for t in {texts[i] for i in train if i % 4} for w in scorer.weights(t)])
    assert (own > 0).any() and np.exp(model.lam * own).mean() == pytest.approx(1.0, abs=1e-6)


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[10:10] = ["awful", "rubbish"]
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    held = {r["doc_id"] for r in spark.createDataFrame(labels, "doc_id long, toxic int").where(toxicity.held_out("doc_id")).collect()}
    assert held == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    flipped = [(i, 1 - y if i in held else y) for i, y in labels]
    a = toxicity.toxicity_report(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).orderBy("doc_id").collect()
    b = toxicity.toxicity_report(docs(spark, texts, True), spark.createDataFrame(flipped, "doc_id long, toxic int")).orderBy("doc_id").collect()
    assert [r["score"] for r in a] == [r["score"] for r in b]
    assert all(r["predicted"] == y for r, (_, y) in zip(a, labels)) and all(0 <= r["score"] <= 1 for r in a)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(docs(spark, EDGE), none).collect()
    assert len(rows) == len(EDGE) and {r["predicted"] for r in rows} == {0}
    assert toxicity.toxicity_report(docs(spark, []), none).count() == 0
    some = spark.createDataFrame([(5, 1), (None, 1), (6, None), (5, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_report(docs(spark, EDGE), some).count() == len(EDGE)


def test_passages_are_spans_of_the_text(spark):
    model = toxicity.Model(weights={"awful": 8.0}, lam=1.0, k=0.1, curve=(-5.0, 3.0, 0.1))
    row = toxicity.score_texts(docs(spark, ["it is an Awful, thing to say"]), model).first()
    (p,) = row["passages"]
    assert "it is an Awful, thing to say"[p["first"] : p["last"]] == "Awful," and row["score"] > 0.3


# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain &lt;text&gt; &eacute;", "plain <text> é"),
        ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>A  b\n c<p>d<br>e</article><footer>F</footer>", "T A b c d e"),
        ("<body><article><p>x<b>y</b> z</p><aside>no</aside><form><input value=1>no</form></article><div id=comments><p>no no no</p></div>", "xy z"),
        ("<body><header>no</header><div class='side-bar sidebar'>no</div><main><section><p>one two three</p></section><section><p>four</p></section></main></body>", "one two three four"),
        ("<body class='has-sidebar'><div class='ad'>Buy now</div><div><p>First long paragraph of the text.</p><p>Second one.</p></div><script>var t='</p>'</script></body>", "First long paragraph of the text. Second one."),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- no --><style>p{}</style></article>", "a b c d"),
        ("<article><p title='a > b'>ok</p></div></span></article>", "ok"),
        ("<div role='navigation'>no</div><div style='display:none'>no</div><div><p>yes</p></div>", "yes"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("frame", ["<body><div>{0}</div><p><a href=x>More</a></p></body>", "<body>{0}</body>"])
def test_every_article_above_the_threshold_is_kept(frame):
    stories = ["first story text, long enough. " * 8, "second story words here. " * 9, "third words. " * 14]
    page = frame.format("".join(f"<article><h2>Part {i}</h2><p>{t}</p></article>" for i, t in enumerate(stories)))
    assert html_text.main_text(page) == " ".join(f"Part {i} {t.strip()}" for i, t in enumerate(stories))


def plain_select(root):
    """The selection by definition: every density from its own subtree, every subtree tried."""
    below = lambda n: [n, *(x for c in n.children if isinstance(c, html_text.Node) for x in below(c))]
    chars = lambda n: sum(chars(c) if isinstance(c, html_text.Node) else len(" ".join(c.split())) for c in n.children)
    link_chars = lambda n: chars(n) if n.tag == "a" else sum(link_chars(c) for c in n.children if isinstance(c, html_text.Node))
    link_tags = lambda n: len(below(n)) - 1 if n.tag == "a" else sum((c.tag == "a") + link_tags(c) for c in n.children if isinstance(c, html_text.Node))
    nodes = below(root)
    body = next((n for n in nodes if n.tag == "body"), root)

    def density(n):
        c, t, lc, lt = chars(n), max(1, len(below(n)) - 1), max(1, link_chars(n)), max(1, link_tags(n))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - link_chars(n)) * lc + link_chars(body) / max(1, chars(body)) * c + math.e)
        return max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001))) if base > 1 else c / t

    total = {id(n): sum(density(c) for c in n.children if isinstance(c, html_text.Node) and c.tag not in html_text.INLINE) for n in nodes}
    best = next(n for n in nodes if total[id(n)] == max(total.values()))
    if not chars(best):
        return [root] if chars(root) else []
    if best in (root, body) or best.tag == "html":
        return [best]
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(map(density, path))
    chosen = [n for n in below(body) if n is best or (density(n) >= threshold and chars(n) and n not in path)]
    inside = {id(x) for n in chosen for x in below(n)[1:]}
    return [n for n in chosen if id(n) not in inside]


def test_selection_against_definition():
    rng = random.Random(31)

    def element(depth):
        text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 0, 1, 3, 9, 25])))
        tag = rng.choice(["div", "div", "section", "p", "a", "b", "ul"])
        return f"<{tag}>{text()}" + "".join(element(depth - 1) + text() for _ in range(rng.randint(0, 3) if depth else 0)) + f"</{tag}>"

    several = 0
    for _ in range(300):
        root = html_text.parse("<body>" + "".join(element(rng.randint(1, 3)) for _ in range(rng.randint(1, 4))) + "</body>")
        got = html_text.select(root)
        assert list(map(id, got)) == list(map(id, plain_select(root)))
        several += len(got) > 1
    assert several > 20


STORY = "<div class='ad'>Buy</div><div>{0}<h1>Title of it</h1><p><b>First long paragraph of the story, with words enough.</b><br><p>Second.</p><p>Third one, a bit longer again.</p>{1}</div><footer>Imprint</footer>"


def test_pages_without_semantic_tags():
    want = "Title of it First long paragraph of the story, with words enough. Second. Third one, a bit longer again."
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(12)) + "</ul>"
    for before, after in (("", ""), ("<article>", "</article>"), ("<section>", "</section>"), ("<main><div>", "</div></main>")):
        assert html_text.main_text(f"<body>{menu}{STORY.format(before, after)}</body>") == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</span>" * 100_000, "<table><tr><td>" + "<b>" * 50_000 + "<td>x" * 50_000, "<div>" * 100_000 + "</i>" * 100_000, "<nav>" + "<div>" * 100_000 + "</span>" * 100_000])
def test_stray_tags_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def test_html_query_and_deep_nesting(spark):
    deep = "<div>" * 30_000 + "<p>deep</p>"
    pages = spark.createDataFrame([(1, "u", deep), (2, None, None), (2, None, None), (None, "u", "<p>x y</p>")], "page_id long, url string, html string")
    got = html_text.extract_text(pages.withColumn("text", F.lit("clash"))).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "x y", 3), (1, "deep", 4), (2, "", 0), (2, "", 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- URLs


def test_cascade_is_exact():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    for size in (0, 1, 500, len(keys)):
        listed, others = keys[:size], keys[size:]
        levels = url_filter.build_levels(listed, others)
        assert url_filter.is_member(listed, levels).all() and not url_filter.is_member(others, levels).any()
        assert size in (0, len(keys)) or len(levels) > 1 or size == 1


@pytest.mark.parametrize("shard_keys, limit", [(200_000, 64 << 20), (3, 64 << 20), (3, 40)])
def test_url_verdicts(spark, monkeypatch, shard_keys, limit):
    monkeypatch.setattr(url_filter, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    urls = ["http://A.example.org/es/x?q#f", "https://example.org/en/12", "http://b.org/zz", "http://x.com/fr/a", "http://x.com/de/a", "http://notorg/", "http://m.bad.net/a", None, "nothing",
            "ftp://h", "http://h?x://y/", "http://xexample.org/es/", "http://m.bad.net", "http://\ud83d\ude00.net/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = pages.select(url_filter.host_of(F.col("url")).alias("key")).where("key LIKE 'm.%'")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.RULES, listed).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block") and got[5] == ("notorg", "/", None, "allow")
    assert got[6] == ("m.bad.net", "/a", None, "block") and got[7] == ("", "", None, "allow") == got[8] and got[9] == ("h", "", None, "allow")
    assert got[10] == ("h", "", None, "allow") and got[11][2:] == ("org/", "allow") and got[12][3] == "block"
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES, listed.limit(0)).count() == 0


def test_insecure_hosts(spark):
    urls = ["http://a.b/1", "HTTP://A.b/2", "https://a.b/3", "http://c.d", "https://c.d/x", "ftp://e.f", "http://g.h?x", None, "nothing", "http:///p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r["key"] for r in url_filter.insecure_hosts(pages).collect()} == {"a.b", "g.h"}


# ---------------------------------------------------------------- WARC


def test_archive_round_trip(spark):
    html = {1: "<p>a</p>", 2: "<p>a</p>", 3: None, 4: "", 5: "é\r\nWARC/1.1\r\n", 7: "<p>a</p>"}
    pages = spark.createDataFrame([(k, f"http://x/{k}\n", v) for k, v in html.items()], "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.archive_report(pages).collect()}
    for k, v in html.items():
        data = (v or "").encode()
        peers = [p for p, w in html.items() if (w or "") == (v or "")]
        assert got[k]["payload_bytes"] == len(data) and got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if k == max(peers) else ("revisit", max(peers)))
    archive = warc.write_archive(pages)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in warc.restore_payloads(spark, archive).collect()} == {k: v or "" for k, v in html.items()}
    record = {r["page_id"]: bytes(r["record"]) for r in warc.read_archive(spark, archive).collect()}
    assert record[5].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record[5].endswith("\r\n\r\né\r\nWARC/1.1\r\n\r\n\r\n".encode())
    for k, bytes_ in record.items():
        head, _, block = bytes_.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields) and fields["WARC-Target-URI"] == f"http://x/{k}%0A"
        assert len(block) == int(fields["Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")  # the block, then two line ends
        if fields["WARC-Type"] == "response":
            assert fields["Content-Type"] == "application/http;msgtype=response" and block[:-4].partition(b"\r\n\r\n")[2].decode() == (html[k] or "")
    assert all(r["record_type"] == "response" for r in warc.archive_report(pages, min_bytes=100).collect())
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_repeated_page_ids_and_null_ids(spark):
    pages = spark.createDataFrame([(3, "u", "x"), (3, "v", "x"), (1, "w", "x"), (None, "w", "x"), (None, None, "y"), (2, None, "y")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive_report(pages).collect())
    assert got == [(0, "revisit", 2), (0, "revisit", 3), (1, "revisit", 3), (2, "response", None), (3, "response", None), (3, "response", None)]
    alone = spark.createDataFrame([(None, "u", "z")], "page_id long, url string, html string")
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_report(alone).collect()] == [(None, "response", None)]


def test_a_revisit_of_another_payload_is_found(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "y")], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    records = spark.read.parquet(archive.records)
    other = records.where("page_id = 3").first()["address"]
    records.withColumn("address", F.when(F.col("page_id") == 1, other).otherwise(F.col("address"))).write.parquet(archive.records + "-moved")
    with pytest.raises(Exception, match="another payload"):
        warc.verified_records(spark, warc.Archive(archive.records + "-moved", archive.payloads)).collect()


def test_damage_is_found(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    broken = spark.read.parquet(archive.payloads).withColumn("address", F.lit("0" * 64))
    broken.write.parquet(archive.payloads + "-broken")
    with pytest.raises(Exception, match="missing or damaged"):
        warc.read_archive(spark, warc.Archive(archive.records, archive.payloads + "-broken")).collect()


# ---------------------------------------------------------------- licenses


def test_licenses_against_plain_version(spark):
    texts = [*EDGE, "CC BY cc by", "x General\nPublic-License y all RIGHTS, reserved!", "a\nLicensed under the Apache License, Version 2.0\nb", "Licensed under the Apache License, Version",
             "Released under the MIT Licence", "Released, under the MIT (License)"]
    got = {r["doc_id"]: r for r in license_scan.license_report(docs(spark, texts, True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = [w.decode() for w in common.alnum_words(t)]
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            own = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        more, best = set(), 0.0
        for line in (t or "").split("\n"):
            held = {w.decode() for w in common.alnum_words(line)}
            for label, template in license_scan.TEMPLATES:
                want = set(license_scan.template_words(template))
                if len(want & held) >= license_scan.THRESHOLD * len(want) - 1e-9:
                    more.add(label)
                    best = max(best, len(want & held) / len(want))
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and r["labels"] == ",".join(sorted(labels | more))
        assert r["score"] == pytest.approx(1.0 if places else best)
    assert license_scan.license_report(docs(spark, [])).count() == 0


def test_notices_wrapped_over_lines_are_found(spark):
    mit = "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the Software) */"
    bsd = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that\n\nthe following conditions are met:"
    torn = "\n".join(license_scan.TEMPLATES[-1][1].split())
    far = "Released under\n" + "some other words " * 10 + "\nthe MIT License"
    deep = " ".join(WORDS * 12) + "\n"
    texts = [mit, bsd, torn, far, *("word " * k + deep + "Licensed under the Apache\nLicense, Version 2.0\n" + deep for k in range(0, 210, 7))]
    got = {r["doc_id"]: r for r in license_scan.license_report(docs(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(4)] == ["mit", "bsd", "unlicense", ""] and [got[i]["score"] for i in range(4)] == [1.0, 1.0, 1.0, 0.0]
    assert {(r["labels"], r["score"]) for i, r in got.items() if i > 3} == {("apache-2.0", 1.0)}


def test_licenses_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(41)
    pool = [w for _, t in license_scan.TEMPLATES for w in t.replace(",", "").split()] + WORDS
    texts = [*EDGE[:6], "a\nReleased under\nthe MIT License\nb", "Released under the MIT License"]
    for _ in range(60):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 500))]
        if rng.random() < 0.7:
            notice = rng.choice(license_scan.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                notice.insert(rng.randrange(len(notice)), "x")
            if rng.random() < 0.3:
                notice.pop(rng.randrange(len(notice)))
            at = rng.randint(0, len(words))
            words[at:at] = notice
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", ", "]) for w in words))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841 - DuckDB reads it by name
    want = {r[0]: r[1:] for r in duckdb.sql(license_scan.oracle_sql()).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.license_report(docs(spark, texts)).collect()}
    assert got == want and sum(bool(r[5]) for r in got.values()) > 10


# ---------------------------------------------------------------- quality


def plain_measures(t):
    words = common.space_words(t)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if common.space_words(x)]
    return len(words), sum(len(w.decode()) for w in words), sum((t or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(hit)


def test_base_measures_against_plain_version():
    rng = random.Random(2)
    texts = EDGE[:-2] + ["".join(rng.choice("ab \n#\x0b\u00a0") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    for t in texts:
        assert quality.base_measures(t) == plain_measures(t)


def test_kneser_ney_sums_to_one():
    text = "the cat sat on the mat and the dog sat on the log " * 3
    keys, counts = np.unique(quality.prose_ngrams(text), return_counts=True)
    model = quality.Model(*(a.tobytes() for a in quality.estimate(keys, counts)))
    for context in (0, (20 << 12) | (8 << 6) | 5, (63 << 12) | (62 << 6) | 61):
        grams = np.array([(context << 6) | s for s in range(64)], dtype=np.uint32)
        assert np.exp(model.log_probs(grams)).sum() == pytest.approx(1.0, abs=1e-4)


def test_kneser_ney_against_plain_version():
    """Modified Kneser-Ney by definition, over dictionaries of unit tuples."""
    rng = random.Random(19)
    text = " ".join(rng.choice(["the", "cat", "sat", "Sat", "on", "a", "mat", "é", "日", "x1"]) for _ in range(400))
    units = [0, 0, 0, *quality.symbols(text).tolist()]
    counts = {4: {}}
    for i in range(len(units) - 3):
        g = tuple(units[i : i + 4])
        counts[4][g] = counts[4].get(g, 0) + 1
    for order in (3, 2, 1):  # continuation counts: distinct units before
        counts[order] = {}
        for g in counts[order + 1]:
            counts[order][g[1:]] = counts[order].get(g[1:], 0) + 1
    discount = {}
    for order, own in counts.items():
        n = [sum(c == k for c in own.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        raw = [0.0, 0.5, 0.5, 0.5] if y is None else [0.0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        discount[order] = raw if y is None else [0.0] + [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw[1:])]

    def p(g):
        order = len(g)
        if not order:
            return 1 / 64
        own = {h: c for h, c in counts[order].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        d, total = discount[order], sum(own.values())
        back = sum(d[min(c, 3)] for c in own.values()) / total
        c = own.get(g, 0)
        return (c - d[min(c, 3)] if c else 0.0) / total + back * p(g[1:])

    keys, n = np.unique(quality.prose_ngrams(text), return_counts=True)
    model = quality.Model(*(a.tobytes() for a in quality.estimate(keys, n)))
    seen = [tuple(units[i : i + 4]) for i in rng.sample(range(len(units) - 3), 60)]
    odd = [tuple(rng.choice(units) for _ in range(4)) for _ in range(60)] + [tuple(rng.randrange(64) for _ in range(4)) for _ in range(30)]
    grams = np.array([(a << 18) | (b << 12) | (c << 6) | d for a, b, c, d in seen + odd], dtype=np.uint32)
    assert np.exp(model.log_probs(grams)) == pytest.approx([p(g) for g in seen + odd], rel=2e-5)


def test_bands_reject_on_both_sides(spark):
    rows = spark.createDataFrame([("en", 50, 400, 2.0 + i / 100, 0) for i in range(100)] + [("en", 50, 400, x, 0) for x in (0.2, 9.0)], "lang string, n_words long, n_scored long, log_ppl double, n_repeat_words long")
    model = spark.createDataFrame([("en",), ("*",)], "lang string")
    bands = quality.Bands()
    (low, high), = [quality.limits(rows, model, bands)["en"]]
    q1, q3 = 2.25, 2.76
    assert low == pytest.approx(q1 - 3 * (q3 - q1), abs=0.08) and high == pytest.approx(q3 + 3 * (q3 - q1), abs=0.08)
    verdict = quality.with_verdict(rows, quality.limits(rows, model, bands), bands).select("log_ppl", "kept").collect()
    assert {r["log_ppl"] for r in verdict if not r["kept"]} == {0.2, 9.0}


def test_long_texts_are_scored_in_parts(spark):
    rng = random.Random(23)
    long = " ".join(rng.choice(WORDS) for _ in range(90_000))  # over 400,000 characters
    rows = docs(spark, [long, *(" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(60))])
    got = {r["doc_id"]: r for r in quality.quality_report(rows).collect()}
    model = {r["lang"]: quality.Model(*(bytes(r[c]) for c in ("keys", "logp", "contexts", "logb"))) for r in quality.train(rows).collect()}
    use = model.get("en") or model["*"]
    want = -float(use.log_probs(quality.prose_ngrams(long)).sum()) / quality.count_letters(long)
    assert got[0]["log_ppl"] == pytest.approx(want, rel=1e-9) and got[0]["n_words"] == 90_000


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice(WORDS) for _ in range(60)) + "." for _ in range(300)]
    junk = [" ".join(rng.choice(WORDS) + "%%%&&&" for _ in range(60)) for _ in range(5)]
    rows = docs(spark, prose + junk + EDGE, True)
    got = {r["doc_id"]: r for r in quality.quality_report(rows).collect()}
    assert len(got) == 314 and sum(got[i]["kept"] for i in range(300)) == 300 and not any(got[i]["kept"] for i in range(300, 305))
    assert got[305]["base_failed"] and got[305]["n_words"] == 0
    kept = quality.keep_documents(rows)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.quality_report(docs(spark, [])).count() == 0
    signs = quality.quality_report(docs(spark, ["# % # % " * 20, None])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["log_ppl"]) for r in signs] == [(80, None), (0, None)]


def test_all_characters_are_counted_and_distinct(spark):
    chars = [chr(c) for c in [*range(33, 127), *range(0xA0, 0x700), *range(0x4E00, 0x4F00), 0x1F600, 0x40000, 0x10FFFF]] + [" "]
    assert len({quality.symbols(c).tobytes() for c in chars}) == len(chars)
    for text in ("a#*(x) [y] {z} | <t>", "日本語 é Ж"):
        assert len(quality.prose_ngrams(text)) == len(quality.symbols(text)) >= len(text)
    assert quality.count_letters("Ab1 é日 #(!)") == 5
    rng = random.Random(12)
    code = [" ".join(f"{rng.choice(WORDS)}({rng.choice(WORDS)}[{rng.choice(WORDS)}]);" for _ in range(30)) for _ in range(120)]
    prose = [" ".join(rng.choice(WORDS) for _ in range(60)) + "." for _ in range(180)]
    got = {r["doc_id"]: r for r in quality.quality_report(docs(spark, code + prose + ["#%&! (*) $$ " * 4 + "#|| " * 3])).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not got[300]["kept"]


# ---------------------------------------------------------------- packing


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    encode, whole = packing.encoder(path), Tokenizer.from_file(path)
    for t in ["Hello wörld  \n\n 123 don't", "a<|endoftext|>b", "  ", "日本語 text\x00", "é" * 300, *[t for t in EDGE if t]]:
        assert encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["\n" * 1_000_000 + "a", " " * 1_000_000, " " * 60_000 + "x" + "\t" * 40_000, "a" * 200_000, "word " * 20_000])
def test_ids_of_very_long_runs_equal_the_library(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_panics_of_the_fast_engine_only_are_held_back(monkeypatch):
    monkeypatch.setattr(packing, "LONG_SPACE", packing.re.compile("(?!)"))  # let the run through to the fast engine
    assert len(packing.encoder(packing.default_tokenizer())(" " * 700_000 + "x")) > 0


def test_first_fit_decreasing_against_scan():
    rng = random.Random(6)
    for _ in range(50):
        lengths = np.array(sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 80))), reverse=True))
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free: list[int] = []
        for n, b, o in zip(lengths, bins, offsets):
            k = next((i for i, f in enumerate(free) if f >= n), len(free))
            if k == len(free):
                free.append(100)
            assert (b, o) == (k, 100 - free[k])
            free[k] -= n


def test_packing_is_whole_and_gapless(spark):
    texts = [*EDGE, *(" ".join(random.Random(i).choice(WORDS) for _ in range(i * 37 % 3000)) for i in range(60))]
    rows = packing.pack_documents(docs(spark, texts, True)).collect()
    encode = packing.encoder(packing.default_tokenizer())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.append(encode(t) if t else np.zeros(0, dtype="<u4"), np.uint32(1)).astype("<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
    assert total / (2048 * len(by_sequence)) > 0.9
    assert packing.pack_documents(docs(spark, [])).count() == 0
    null_ids = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert packing.pack_documents(null_ids).count() == 2


# ---------------------------------------------------------------- null ids, repeated rows


@pytest.mark.parametrize("name", ["toxicity", "license", "quality", "leaks", "urls"])
def test_null_ids_and_repeated_rows_are_rows_each(spark, name):
    text = "Released under the MIT License, all rights reserved, with ten or more words in it, you see"
    rows = spark.createDataFrame([(None, text, "en"), (None, text, "en"), (7, text, None), (7, text, None), (7, "another one", "en"), (None, None, None)], "doc_id long, text string, lang string")
    rows = rows.withColumns({"host": F.lit("clash"), "text_hash": F.lit(1), "f_id": F.lit(2), "url": F.lit("http://m.a.net/x"), "page_id": F.col("doc_id")})
    run = {
        "toxicity": lambda: toxicity.toxicity_report(rows, spark.createDataFrame([(7, 1), (None, 0)], "doc_id long, toxic int")),
        "license": lambda: license_scan.license_report(rows),
        "quality": lambda: quality.quality_report(rows),
        "leaks": lambda: dec.leak_report(rows, spark.createDataFrame([(1, "with ten or more words in it"), (None, "another")], "item_id long, text string")).drop("spans"),
        "urls": lambda: url_filter.judge_urls(rows, url_filter.RULES, url_filter.insecure_hosts(rows)),
    }[name]
    got = [tuple(r) for r in run().collect()]
    assert len(got) == 6 and sum(r[0] is None for r in got) == 3
    if name not in ("toxicity", "urls"):  # equal rows get equal results
        assert len(set(got)) == 4 and max(got.count(r) for r in got) == 2


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("block", [500_000, 7])
def test_leaks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK_WINDOWS", block)
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(99, None), (None, "q r s t u v w x y z"), (3, "é-Ü x1")]
    texts = [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(10)] + ["A, b; c é!Ü x1", "..q r s t u v w x y z..", *EDGE]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[:6] for r in dec.leak_report(docs(spark, texts, True), bench).collect())
    assert got == sorted(dec.brute_force(list(enumerate(texts)), items))
    clean = dec.without_leaks(docs(spark, texts, True), bench)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in got if not r[5]} and "spans" in clean.columns
    assert dec.leak_report(docs(spark, []), bench).count() == 0
    assert dec.leak_report(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_spans_are_offsets_of_the_original(spark):
    bench = spark.createDataFrame([(1, "Find THIS passage")], "item_id long, text string")
    row = dec.find_leaks(docs(spark, ["é — find,  this\npassage! then"]), bench).first()
    (s,) = row["spans"]
    assert "é — find,  this\npassage! then"[s["first"] : s["last"]] == "find,  this\npassage"
