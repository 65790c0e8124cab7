"""Exact removal of repeated byte strings by the phrases of prefix-free parsing.

A string of ``depth`` bytes is repeated when it starts at two or more places of the corpus. Every byte that a
repeated string covers is removed; matches never cross documents.

Parsing. Each text is rolled over with a 16-byte hash. The trigger of a starting place s is the smallest hash in the
``reach`` places from s on, so it depends on the bytes of s's own string alone; the starting places that share a
trigger form a phrase. The *context* of a phrase are the bytes that all its strings have in common from the trigger on
(``depth - reach + 1``); its *entry* are all bytes its strings cover. The dictionary holds the distinct entries, and
the parse is the sequence of entries of a document. Equal strings have equal triggers, hence equal contexts: only
entries of one context can hold equal strings. So the suffixes of the dictionary need to be merged with the parse
inside a context only, and only into classes of equal strings, not into an order:

1. contexts are counted; those seen once cannot repeat;
2. entries of the others are counted: an entry seen twice repeats with all its strings, without a look at them;
3. contexts with several entries are opened: the distinct entries bring their bytes once, from one of their places. Of
   each run of PIECE starting places, entries first compare what all of its strings have in common; where that is
   equal, the dictionary suffixes themselves are, by hash. Both are counts with map-side sums: no context, however
   large, is gathered in a task.

Step 3 works on a small part of highly repetitive text, because copies share their entries. A sorted suffix array of the
corpus is not built: it would hold a row for every byte (see the README for figures).

Passages. The first ``passage`` bytes of a context, seen twice, are a string of that many bytes that starts elsewhere
too. These strings tell of every passage of ``passage + reach + 15`` bytes that repeats, though they do not cover all of
it. They are what step 1 counts, if asked for; a context seen twice begins with one.

Hashes: contexts, entries and strings are identified by independent 64-bit polynomial hashes of their bytes, strings
always together with their context (128 bits). Bit tables (see ``bit_table``) only save rows.

Defined cases: null and empty texts have no bytes and no spans; texts shorter than ``depth`` are kept whole;
repeated rows repeat each other; texts of any length are parsed in slices; an empty table gives no rows; other
columns, whatever their names, are ignored by the report and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_table, discard, free_names, in_table, materialise

DEPTH = 400
REACH = 128
GRAM = 16
#: Bytes of the repeated strings that the report's further columns tell of.
PASSAGE = 200
#: Starting places parsed at once: a worker holds some ten arrays of eight bytes for each, and two tables of powers.
SLICE = 1 << 17
#: Hashes that a worker holds before it sends their counts.
HELD = 1 << 18
#: Starting places whose strings are first compared by their common bytes.
PIECE = 32
CONTEXT_SCHEMA = "context bigint, n int"
ENTRY_SCHEMA = "passage bigint, context bigint, entry bigint, doc_key binary, first int, last int, trigger int"
BYTES_SCHEMA = "context bigint, entry bigint, trigger int, pieces array<bigint>, data binary"


@dataclass(frozen=True)
class Parsing:
    """depth: bytes of a repeated string; reach: places that share a trigger at most; passage: bytes of a passage's string,
    0 for none."""

    depth: int = DEPTH
    reach: int = REACH
    passage: int = 0

    @property
    def context(self) -> int:
        return self.depth - self.reach + 1

    @property
    def counted(self) -> int:
        """Bytes from the trigger on that step 1 counts."""
        return self.passage or self.context

    @property
    def least(self) -> int:
        """Bytes from a starting place on that hold its trigger and what is counted."""
        return self.counted + self.reach - 1

    def __post_init__(self):
        if not GRAM <= self.counted <= self.context:
            raise ValueError("a passage's string must hold a trigger and lie in every string of its phrase")


_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@dataclass
class _Tables:
    letters: np.ndarray
    powers: np.ndarray
    inverses: np.ndarray


_tables: _Tables | None = None


def _powers() -> _Tables:
    """Random values of the 256 bytes, and the powers of the base and of its inverse modulo 2**64."""
    global _tables
    if _tables is None:
        n = SLICE + 2 * DEPTH + REACH + GRAM + 2
        powers, inverses = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        powers[0] = inverses[0] = 1
        with np.errstate(over="ignore"):
            _tables = _Tables(_mix(np.arange(1, 257, dtype=np.uint64)), np.multiply.accumulate(powers), np.multiply.accumulate(inverses))
    return _tables


@dataclass
class Parse:
    """Phrases of one slice: first and last starting place, trigger, hash of what is counted; ``hash(a, b)`` of any
    substring. ``whole`` is the last starting place of a string (``last`` may lie behind it: no string is there)."""

    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    counted: np.ndarray
    sums: np.ndarray
    how: Parsing
    whole: int

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * _powers().inverses[a]

    def ends(self) -> np.ndarray:
        """Last starting place of a string of each phrase; before the first where it has none."""
        return np.maximum(np.minimum(self.last, self.whole), self.first - 1)

    def entry(self) -> np.ndarray:
        """Identity of each phrase's covered bytes and of where its trigger lies in them; 0 where it has no string."""
        ends = self.ends()
        with np.errstate(over="ignore"):
            place = (self.trigger - self.first).astype(np.uint64) << np.uint64(32) | (ends - self.first + 1).astype(np.uint64)
            full = _mix(self.hash(self.first, np.minimum(ends + self.how.depth, len(self.sums) - 1)) + _mix(place + np.uint64(1)))
        return np.where(ends < self.first, np.uint64(0), full)

    def context(self) -> np.ndarray:
        """Hash of the context of each phrase; 0 where it has no string (the context may lie behind the text)."""
        held = self.ends() >= self.first
        return np.where(held, self.hash(self.trigger, np.where(held, self.trigger + self.how.context, self.trigger)), np.uint64(0))


def parse_slice(data: np.ndarray, how: Parsing = Parsing()) -> Parse | None:
    """Parse the bytes of one slice; None when it is shorter than ``how.least``. Bytes behind the starting places of a
    slice are those of ``slices``."""
    n = len(data)
    places = min(SLICE, n - how.least + 1)
    if places <= 0:
        return None
    t, reach = _powers(), how.reach
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(t.letters[data] * t.powers[:n], out=sums[1:])
        size = places + reach - 1
        rolling = _mix((sums[GRAM : GRAM + size] - sums[:size]) * t.inverses[:size])
    top = np.uint64(_M)
    blocks = np.concatenate([rolling, np.full(-size % reach, top, dtype=np.uint64)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:places]
    behind = np.minimum.accumulate(blocks, axis=1).ravel()[reach - 1 : reach - 1 + places]
    least = np.minimum(ahead, behind)
    # a place whose own hash is the least is a trigger: the next place has another one, even of equal hash
    cut = np.flatnonzero((least[1:] != least[:-1]) | (rolling[: places - 1] == least[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [places]]) - 1
    trigger = last.copy()
    far = np.flatnonzero(rolling[last] != least[last])
    for at in range(0, len(far), 4096):
        part = far[at : at + 4096]
        trigger[part] += np.argmax(rolling[last[part][:, None] + np.arange(reach)] == least[last[part]][:, None], axis=1)
    parse = Parse(first, last, trigger, first, sums, how, n - how.depth)
    parse.counted = parse.hash(trigger, trigger + how.counted)
    return parse


def slices(data: bytes, how: Parsing = Parsing()) -> Iterator[tuple[int, np.ndarray]]:
    """Offsets and bytes of slices whose starting places partition those of the text."""
    array = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, max(0, len(array) - how.least + 1), SLICE):
        yield at, array[at : at + SLICE + how.depth - 1]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_key (MD5 of the bytes: rows of equal texts are treated as one place each, and alike) and the bytes."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.unhex(F.md5(data)).alias("doc_key"), data.alias("data"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def count_contexts(docs: DataFrame, how: Parsing) -> DataFrame:
    """Pass 1: the hashes of what is counted that occur at least twice, as ``context``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def sums() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([_long(keys), pa.array(n.astype(np.int32))], names=["context", "n"])

        for batch in batches:
            for value in batch.column(1):
                before = -1
                for at, data in slices(value.as_py(), how):
                    p = parse_slice(data, how)
                    # a phrase that the end of a slice divides is one place, not two
                    held.append(p.counted[int(p.trigger[0] + at == before) :])
                    before = p.trigger[-1] + at
                    size += len(held[-1])
                if size > HELD:
                    yield sums()
                    held, size = [], 0
        if held:
            yield sums()

    rows = _texts(docs).where(F.length("data") >= how.least).mapInArrow(run, CONTEXT_SCHEMA)
    return rows.groupBy("context").agg(F.sum("n").alias("n")).where("n >= 2").select("context")


def find_entries(docs: DataFrame, table, how: Parsing) -> DataFrame:
    """Pass 2: one row per phrase whose counted bytes may occur twice: their hash (passage), context, entry, doc_key, first,
    last (places of its strings; last is before first, and context and entry are 0, where it has none), trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            parts: list[tuple] = []
            keys: list[bytes] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, data in slices(value.as_py(), how):
                    p = parse_slice(data, how)
                    on = np.flatnonzero(in_table(bits, p.counted.view(np.int64)))
                    if len(on):
                        parts.append((p.counted[on], p.context()[on], p.entry()[on], p.first[on] + at, p.ends()[on] + at, p.trigger[on] + at))
                        keys += [key] * len(on)
            if parts:
                passage, context, entry, *places = (np.concatenate(c) for c in zip(*parts))
                columns = [_long(passage), _long(context), _long(entry), pa.array(keys, pa.binary()), *(pa.array(x.astype(np.int32)) for x in places)]
                yield pa.RecordBatch.from_arrays(columns, names=["passage", "context", "entry", "doc_key", "first", "last", "trigger"])

    return _texts(docs).where(F.length("data") >= how.least).mapInArrow(run, ENTRY_SCHEMA)


def key_slots(spans: DataFrame) -> np.ndarray:
    """Bits of doc_key, for ``split_texts``."""
    return bit_table(spans.select(F.conv(F.substring(F.hex("doc_key"), 1, 15), 16, 10).cast("bigint").alias("slot")).distinct(), "slot")


def split_texts(docs: DataFrame, table, inside: bool, key: str = "doc_key") -> DataFrame:
    """The rows of docs(key, ...) whose key may be (inside) or is not (else) in a table of ``key_slots``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _split(batch, table.value, inside, key)

    return docs.mapInArrow(run, docs.schema)


def _split(batch: pa.RecordBatch, bits: np.ndarray, inside: bool, key: str) -> pa.RecordBatch:
    # the first 15 hexadecimal digits of a key
    slots = np.fromiter((int.from_bytes(x[:8], "big") >> 4 for x in batch.column(batch.schema.get_field_index(key)).to_pylist()), dtype=np.int64, count=batch.num_rows)
    return batch.filter(pa.array(in_table(bits, slots) == inside))


def bring_bytes(docs: DataFrame, chosen: DataFrame, how: Parsing) -> DataFrame:
    """chosen(context, entry, doc_key, first, last, trigger) to context, entry, the trigger's place in the entry, hashes of
    the common bytes of its pieces (null where a piece has no string), and the bytes the entry covers. Texts without a
    chosen place are left out before the shuffle, by a bit table."""
    table = docs.sparkSession.sparkContext.broadcast(key_slots(chosen))

    common = how.depth - PIECE + 1

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, places in zip(batch.column(0), batch.column(1).to_pylist()):
                text = value.as_buffer()
                for x in places:
                    data = text[x["first"] : x["last"] + how.depth].to_pybytes()
                    trigger = x["trigger"] - x["first"]
                    low, high = trigger - (x["last"] - x["first"]), trigger  # how far before the trigger its strings start
                    pieces: list[int | None] = [None] * -(-how.reach // PIECE)
                    for k in range(low // PIECE, high // PIECE + 1):
                        at = trigger - k * PIECE
                        pieces[k] = xxhash.xxh3_64_intdigest(data[max(0, at) : at + common], seed=k + 1) - (1 << 63)
                    rows.append((x["context"], x["entry"], trigger, pieces, data))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["context", "entry", "trigger", "pieces", "data"])

    texts = _texts(docs).where(F.length("data") >= how.depth)
    texts = split_texts(texts, table, True).dropDuplicates(["doc_key"])
    places = chosen.groupBy("doc_key").agg(F.collect_list(F.struct("context", "entry", "first", "last", "trigger")).alias("places"))
    return texts.join(places, "doc_key").select("data", "places").mapInArrow(cut_out, BYTES_SCHEMA)


def suffix_hashes(data: bytes, depth: int) -> np.ndarray:
    """Hash of every string of ``depth`` bytes of an entry, by starting place."""
    t, array = _powers(), np.frombuffer(data, dtype=np.uint8)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(array) + 1, dtype=np.uint64)
        np.cumsum(t.letters[array] * t.powers[: len(array)], out=sums[1:])
        return (sums[depth:] - sums[:-depth]) * t.inverses[: len(array) - depth + 1]


def open_contexts(entries: DataFrame, how: Parsing) -> DataFrame:
    """entries(context, entry, trigger, pieces, data) to context, entry, places: the starting places (from the entry's
    first) of strings that another entry of the context holds too. Equal strings lie equally far from their trigger,
    hence in the same piece, and no two places of one entry hold equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for context, entry, trigger, data, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                h = suffix_hashes(data, how.depth)
                at = np.flatnonzero(np.isin((trigger - np.arange(len(h))) // PIECE, pieces))
                parts.append((np.full(len(at), context), np.full(len(at), entry), at.astype(np.int32), h[at]))
            if parts:
                context, entry, place, suffix = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(entry), pa.array(place), _long(suffix)], names=["context", "entry", "place", "suffix"])

    keys = entries.select("context", "entry", F.posexplode("pieces").alias("piece", "key")).where("key is not null")
    shared = keys.groupBy("key").agg(F.min("entry").alias("low"), F.max("entry").alias("high")).where("low <> high").select("key")
    wanted = keys.join(shared, "key", "left_semi").groupBy("context", "entry").agg(F.collect_set("piece").alias("wanted"))
    opened = entries.join(wanted, ["context", "entry"]).select("context", "entry", "trigger", "data", "wanted")
    suffixes = materialise(opened.mapInArrow(run, "context bigint, entry bigint, place int, suffix bigint"), "suffixes")
    twice = suffixes.groupBy("context", "suffix").agg(F.min("entry").alias("low"), F.max("entry").alias("high")).where("low <> high").select("context", "suffix")
    out = materialise(suffixes.join(twice, ["context", "suffix"]).groupBy("context", "entry").agg(F.collect_set("place").alias("places")), "places")
    discard(suffixes)
    return out


def repeated_spans(docs: DataFrame, how: Parsing = Parsing()) -> tuple[DataFrame, DataFrame]:
    """``docs(text)`` to two stored tables: doc_key and the sorted byte ``spans`` [first, last) that repeated strings
    cover; doc_key and the sorted ``passages``, spans of the passages' strings (no rows where ``how.passage`` is 0).

    doc_key is the MD5 of the text's bytes; texts without a span have no row.
    """
    depth, sc = how.depth, docs.sparkSession.sparkContext
    contexts = materialise(count_contexts(docs, how), "repeated-contexts")
    phrases = materialise(find_entries(docs, sc.broadcast(bit_table(contexts, "context")), how), "phrases")
    place = F.struct("doc_key", "first", "last", "trigger")
    counted = materialise(phrases.where("entry <> 0").groupBy("context", "entry").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "entries")
    # entries seen twice repeat as a whole: a context is opened for the others
    groups = counted.groupBy("context").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("once")).where("m > 1 AND once > 0")
    several = materialise(counted.join(groups.select("context"), "context").select("context", "entry", "at.*"), "several")
    found = materialise(bring_bytes(docs, several, how), "entry-bytes")
    places = open_contexts(found, how)
    single = counted.where("n = 1").join(places, ["context", "entry"]).select("context", "entry", "places")
    told = counted.where("n > 1").select("context", "entry", F.lit(None).cast("array<int>").alias("places")).union(single)
    told = phrases.join(told, ["context", "entry"])
    span = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    spans = F.when(F.col("places").isNull(), F.array(span(F.col("first"), F.col("last") + depth))).otherwise(
        F.transform("places", lambda p: span(F.col("first") + p, F.col("first") + p + depth))
    )
    out = materialise(_by_text(told.select("doc_key", _runs(spans, depth).alias("spans")), "spans"), "spans")
    seen = phrases.join(contexts.select(F.col("context").alias("passage")), "passage", "left_semi") if how.passage else phrases.limit(0)
    passages = materialise(_by_text(seen.select("doc_key", F.array(span(F.col("trigger"), F.col("trigger") + how.passage)).alias("passages")), "passages"), "passages")
    discard(contexts, phrases, counted, several, found, places)
    return out, passages


def _by_text(parts: DataFrame, name: str) -> DataFrame:
    """doc_key and all parts of a text, sorted; rows of equal texts have equal parts."""
    return parts.groupBy("doc_key").agg(F.sort_array(F.flatten(F.collect_set(name))).alias(name))


def _runs(spans, depth: int):
    """Merge the overlapping spans of one phrase (all of them start within ``reach`` bytes)."""
    return F.when(F.size(spans) <= 1, spans).otherwise(F.array(F.struct(F.array_min(spans)["first"].alias("first"), F.array_max(spans)["last"].alias("last"))))


def cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans, and the spans merged to maximal runs."""
    runs: list[list[int]] = []
    for span in spans or ():
        a, b = span["first"], span["last"]
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), [(a, b) for a, b in runs]


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeat_report(docs: DataFrame, depth: int = DEPTH, passage: int = PASSAGE) -> DataFrame:
    """The digest columns of the contract: doc_id, n_bytes, n_removed, n_spans, kept_sha256; then n_passages (maximal runs
    of strings of ``passage`` bytes, starting at triggers, that start elsewhere too) and n_passage_bytes in them.

    Only texts that lose bytes are shuffled; of the others, the digest is. A stage runs one Python function at most: each
    further one is another worker process for every task, kept by Spark for the tasks to come."""

    def report(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        rows = []
        for text, own in zip(batch.column(2), spans):
            data = (text.as_py() or "").encode()
            kept, runs = cut(data, own)
            rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, [pa.int64()] * 3 + [pa.string()])]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "doc_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield report(batch, batch.column(3).to_pylist())

    def without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = _split(batch, table.value, False, "doc_key")
            yield report(rest, [None] * rest.num_rows)

    docs = docs.select(F.col("doc_id").cast("bigint"), _digest(F.col("text")).alias("doc_key"), "text")
    spans, passages = repeated_spans(docs, Parsing(depth, passage=passage))
    table = docs.sparkSession.sparkContext.broadcast(key_slots(spans))
    cuts = split_texts(docs, table, True).join(spans.hint("merge"), "doc_key", "left").select("doc_id", "doc_key", "text", "spans")
    kind = "doc_id bigint, doc_key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    told = cuts.mapInArrow(with_spans, kind).union(docs.mapInArrow(without_spans, kind)).join(passages, "doc_key", "left")
    return told.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passages").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *_totals("passages")
    )


def _totals(passages: str) -> list[Column]:
    """n_passages, the maximal runs of sorted spans (0 for null), and n_passage_bytes, the bytes in them."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("size"), F.lit(-1).alias("last"))

    def further(a: Column, x: Column) -> Column:
        new = F.when(x["first"] > a["last"], 1).otherwise(0)
        size = F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], a["last"]))
        return F.struct((a["n"] + new).alias("n"), (a["size"] + size).alias("size"), F.greatest(a["last"], x["last"]).alias("last"))

    total = F.aggregate(passages, start, further)
    return [F.coalesce(total[c], F.lit(0)).cast("bigint").alias(name) for c, name in (("n", "n_passages"), ("size", "n_passage_bytes"))]


def without_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs with all repeated bytes taken out of ``text``; characters cut in part go as a whole. Only texts that lose bytes
    are shuffled."""
    key, own, cuts = free_names(docs, "repeat_key", "span_key", "repeat_spans")
    spans, _ = repeated_spans(docs.select("text"), Parsing(depth))
    table = docs.sparkSession.sparkContext.broadcast(key_slots(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            own = batch.column(batch.schema.get_field_index(cuts)).to_pylist()
            texts = [t if t is None or not s else cut(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column(at).to_pylist(), own)]
            names = [n for n in batch.schema.names if n != cuts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    keyed = docs.withColumn(key, _digest(F.col("text")))
    found = spans.select(F.col("doc_key").alias(own), F.col("spans").alias(cuts))
    told = split_texts(keyed, table, True, key).join(found.hint("merge"), F.col(key) == F.col(own), "left").drop(key, own)
    return told.mapInArrow(run, docs.schema).union(split_texts(keyed, table, False, key).drop(key))
