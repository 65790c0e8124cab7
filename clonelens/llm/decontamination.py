"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

A window is ``width`` consecutive words of an item (an item of fewer words, but at least one, is one window).
All windows go into one automaton over normalised (lower-case) words: its letters are the benchmark's words, numbered, so
a window is a path of as many nodes as it has words. Each document is scanned once, and hits are mapped back through word
numbers to character offsets of the original.

Defined cases: null and empty texts have no words and no hits; items without words have no window; a null item_id
still marks words but is not listed; equal item_ids are one item; repeated documents are judged each by itself;
an empty benchmark hits nothing; other columns and clashing names are left out by explicit selection.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, utf8

WIDTH = 10
#: Windows in one automaton at most (ten nodes each, some 250 MB in a Python worker): its size is bounded, whatever the
#: benchmark holds. A larger one takes a further scan for each further automaton.
BLOCK_WINDOWS = 500_000
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN_SCHEMA = "doc_id bigint, n_words bigint, hits array<int>, items array<string>, spans array<struct<first:int,last:int>>"


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``benchmark(item_id, text)`` to distinct ``window`` (joined words), ``n`` (words) and ``items`` (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(text)
                for at in range(max(1, len(words) - width + 1) if words else 0):
                    part = words[at : at + width]
                    rows.append((b" ".join(part), len(part), item))
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int32()), pa.array(c, pa.string())], names=["window", "n", "item"])

    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "window binary, n int, item string")
    return rows.groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def build_automaton(windows: list[tuple[bytes, int, list[str]]]):
    """The automaton, and the numbers of the benchmark's words (from 1; any other word is 0)."""
    import ahocorasick

    automaton, numbers = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    for window, n, items in windows:
        automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in window.split(b" ")), (n, tuple(items)))
    automaton.make_automaton()
    return automaton, numbers


def scan(words: list[bytes], built) -> tuple[np.ndarray, set[str]]:
    """Word numbers inside any occurrence, and the items found."""
    automaton, numbers = built
    items: set[str] = set()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    if words:
        for last, (n, ids) in automaton.iter(tuple(map(numbers.get, words, repeat(0)))):
            edge[last - n + 1] += 1
            edge[last + 1] -= 1
            items.update(ids)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0).astype(np.int32), items


def original_spans(text: str, hits: np.ndarray) -> list[tuple[int, int]]:
    """Character spans [first, last) in the original text of the maximal runs of hit words."""
    if not len(hits):
        return []
    words = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    breaks = np.flatnonzero(np.diff(hits) > 1)
    runs = zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(hits) - 1]]))
    return [(words[hits[a]][0], words[hits[b]][1]) for a, b in runs]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_words, hit word numbers, items found, original spans.

    The windows are read in blocks of at most BLOCK_WINDOWS (one block for any usual benchmark); only a block is on
    the driver and broadcast at a time. Further blocks refine the same rows in further map-only passes.
    """
    windows = item_windows(benchmark, width).cache()
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    sc = docs.sparkSession.sparkContext
    state = docs.select(
        F.col("doc_id").cast("bigint"), "text", F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items")
    )
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        sent = sc.broadcast([(bytes(r["window"]), r["n"], list(r["items"])) for r in part])
        last = block == blocks - 1
        schema = SPAN_SCHEMA if last else "doc_id bigint, text string, hits array<int>, items array<string>"
        state = state.mapInArrow(_scanner(sent, last), schema)
    windows.unpersist()
    return state


def _scanner(sent, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(sent.value)
        has_words = bool(sent.value)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, old, known in zip(*(c.to_pylist() for c in batch.columns)):
                words = alnum_words(text)
                hits, items = scan(words, automaton) if has_words else (np.zeros(0, dtype=np.int32), set())
                if old:
                    hits = np.union1d(hits, np.array(old, dtype=np.int32)).astype(np.int32)
                found = sorted(items | set(known or ()))
                if last:
                    spans = [{"first": a, "last": b} for a, b in original_spans(text or "", hits)]
                    out.append((doc_id, len(words), hits.tolist(), found, spans))
                else:
                    out.append((doc_id, text, hits.tolist(), found))
            columns = list(zip(*out)) if out else [()] * (5 if last else 4)
            spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            kinds = [pa.int64(), pa.int64() if last else pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), spans_type]
            names = ["doc_id", "n_words" if last else "text", "hits", "items", "spans"]
            k = 5 if last else 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names[:k])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window; map-only passes, one for each block."""
    windows = item_windows(benchmark, width).cache()
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))

    def cleaner(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(sent.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                clean = [not sent.value or not len(scan(alnum_words(t.as_py()), automaton)[0]) for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        sent = docs.sparkSession.sparkContext.broadcast([(bytes(r["window"]), r["n"], list(r["items"])) for r in part])
        docs = docs.mapInArrow(cleaner(sent), docs.schema)
    windows.unpersist()
    return docs


def leak_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The digest columns of the decontamination contract, from ``find_leaks``."""
    found = find_leaks(docs, benchmark, width)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "spans",
    )


def brute_force(docs: list[tuple], benchmark: list[tuple], width: int = WIDTH) -> list[tuple]:
    """Quadratic reference for tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    out = []
    for doc_id, text in docs:
        words = alnum_words(text)
        hit, items = set(), set()
        for item, item_text in benchmark:
            own = alnum_words(item_text)
            for at in range(max(1, len(own) - width + 1) if own else 0):
                part = own[at : at + width]
                for i in range(len(words) - len(part) + 1):
                    if words[i : i + len(part)] == part:
                        hit.update(range(i, i + len(part)))
                        if item is not None:
                            items.add(str(item))
        sha = hashlib.sha256(utf8(",".join(sorted(items)))).hexdigest()
        out.append((doc_id, len(words), len(hit), len(items), sha, bool(hit)))
    return out


def oracle_sql(width: int = WIDTH) -> str:
    """The query's result in DuckDB SQL, by joining the windows of items with those of documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '" + r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+" + "'), lambda x: x <> '')"
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), item AS (SELECT item_id, {words} AS w FROM benchmark),
cut AS (SELECT item_id, w, least({width}, len(w)) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM cut)),
sizes AS (SELECT DISTINCT k FROM win),
gram AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, sizes WHERE len(w) >= k)),
hit AS (SELECT r, s, k, item_id FROM gram JOIN win USING (k, g)),
place AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM doc LEFT JOIN place USING (r) LEFT JOIN found USING (r)"""
