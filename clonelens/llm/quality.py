"""Quality rules: fixed base rules plus perplexity bands of a modified Kneser-Ney model.

The model is an order-4 language model over characters written in 64 units, one per language. Every character has its
own code of one to five units. Spark counts all 4-grams of every document, whatever they hold (each task sums its own
before the shuffle); 64 units bound a language's 4-grams by 64**4, so a language's counts fit one task whatever the corpus size. The smoothed probabilities are kept
in sorted arrays of packed 24-bit hashes and read by binary search. Languages with fewer than ``min_chars``
characters share one pooled model, which bounds the number of models by the corpus.

A document's negative log-probability per letter or digit (other characters add to what is improbable, not to the
length; every character is scored) is compared with its language's band: quartiles of log-perplexity over all
documents of the language, widened as ``Bands`` says. Documents outside are rejected.

Defined cases: null and empty texts have no words and fail the base rule; a null or rare language is pooled; a
document without letters and digits has no score and lies outside every band (in a corpus without any, there is no band
and the base rule decides); repeated rows are judged alike; an empty
table gives no rows; other columns are ignored by the report and kept by ``keep_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, space_words

ORDER = 4
POOLED = "*"
#: The symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BROADCAST_BYTES = 192 << 20

NGRAM_SCHEMA = "lang string, ngram int, n bigint"
MODEL_SCHEMA = "lang string, keys binary, logp binary, contexts binary, logb binary"


@dataclass(frozen=True)
class Bands:
    """Log-perplexity may leave the language's quartiles by low (high) interquartile ranges, plus low_short
    (high_short) / sqrt(letters and digits): the mean over a short text strays by that order by chance."""

    low: float = 3.0
    high: float = 3.0
    low_short: float = 4.0
    high_short: float = 6.0


#: White space of ASCII, which is one unit.
SPACES = (9, 10, 11, 12, 13, 32)


def _ascii_units() -> tuple[np.ndarray, np.ndarray]:
    """Units of every ASCII character, and how many it has."""
    table, size = np.zeros((128, 2), dtype=np.uint8), np.ones(128, dtype=np.int64)
    rest = 0
    for code in range(128):
        if 97 <= code <= 122:
            table[code, 0] = code - 96
        elif 48 <= code <= 57:
            table[code, 0] = 29 + code - 48
        elif 65 <= code <= 90:
            table[code], size[code] = (27, code - 64), 2
        elif code not in SPACES:
            table[code], size[code] = (28, rest), 2
            rest += 1
    return table, size


_ASCII, _ASCII_SIZE = _ascii_units()
_ASCII_LETTER = np.array([chr(c).isalnum() for c in range(128)])


def symbols(text: str) -> np.ndarray:
    """Characters as 6-bit units; no two characters but white space share a code. White space 0, a-z 1-26, a capital 27
    and its letter, digits 29-38, the rest of ASCII 28 and a unit; code points A0-65F 39-61 and a unit, others up to
    3FFFF 62 and three units, the rest 63 and four."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    low = np.minimum(codes, 127)
    size = _ASCII_SIZE[low]
    other = np.flatnonzero(codes > 127)
    if len(other):
        size[other] = np.where((codes[other] >= 0xA0) & (codes[other] < 0x660), 2, np.where(codes[other] < 1 << 18, 4, 5))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    out[start] = _ASCII[low, 0]
    pair = np.flatnonzero((size == 2) & (codes < 128))
    out[start[pair] + 1] = _ASCII[codes[pair], 1]
    if len(other):
        n, at, code = size[other], start[other], codes[other]
        two = n == 2
        code = np.where(two, code - 0xA0, code)
        out[at] = np.where(two, 39 + (code >> 6), 58 + n)
        for k in range(1, 5):
            has = n > k
            out[at[has] + k] = (code[has] >> (6 * (n[has] - 1 - k))) & 63
    return out


def count_letters(text: str) -> int:
    """Letters and digits of any script."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    other = codes > 127
    found = int(_ASCII_LETTER[codes[~other]].sum())
    if other.any():
        kinds, n = np.unique(codes[other], return_counts=True)
        found += sum(int(k) for c, k in zip(kinds.tolist(), n) if chr(c).isalnum())
    return found


def pack(units: np.ndarray) -> np.ndarray:
    """4-grams as 24-bit numbers, one per unit from the fourth on."""
    s = units.astype(np.uint32)
    return (s[:-3] << np.uint32(18)) | (s[1:-2] << np.uint32(12)) | (s[2:-1] << np.uint32(6)) | s[3:]


def prose_ngrams(text: str) -> np.ndarray:
    """The 4-grams of a text, for the model and for its score: all of them, one per unit; three boundary symbols stand
    before the text."""
    return pack(np.concatenate([np.zeros(ORDER - 1, dtype=np.uint8), symbols(text)]))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``docs(lang, text)`` to counts per language and 4-gram; tasks add up their own counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def fold() -> None:
            for lang, parts in held.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    old_keys, old_counts = sums[lang]
                    keys, back = np.unique(np.concatenate([old_keys, keys]), return_inverse=True)
                    total = np.zeros(len(keys), dtype=np.int64)
                    np.add.at(total, back, np.concatenate([old_counts, counts]))
                    counts = total
                sums[lang] = (keys, counts)
            held.clear()

        for batch in batches:
            texts = batch.column(1)
            for i, lang in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py()
                if text:
                    held.setdefault(POOLED if lang is None else lang, []).append(prose_ngrams(text))
                    size += len(text)
                if size > 1_000_000:
                    fold()
                    size = 0
        fold()
        for lang, (keys, counts) in sums.items():
            for at in range(0, len(keys), 100_000):
                k, n = keys[at : at + 100_000], counts[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "ngram", "n"])

    return docs.select("lang", "text").mapInArrow(run, NGRAM_SCHEMA).groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times.

    Where these are zero (dense counts) the absolute discount 0.5 stands in.
    """
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def estimate(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Modified Kneser-Ney from sorted 4-gram counts: hash arrays of all orders, each tagged by its order.

    Returns sorted keys and log-probabilities of the n-grams seen, sorted contexts and their log back-off weights.
    An n-gram of order k is tagged k << 24. Lower orders use continuation counts.
    """
    levels = {ORDER: (keys.astype(np.int64), counts.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):
        longer = levels[order + 1][0]
        shorter, n = np.unique(longer & ((1 << (6 * order)) - 1), return_counts=True)
        levels[order] = (shorter, n.astype(np.float64))
    all_keys, all_logp, all_contexts, all_logb = [], [], [], []
    lower_keys, lower_p = np.arange(64, dtype=np.int64), np.full(64, 1 / 64)
    for order in range(1, ORDER + 1):
        k, n = levels[order]
        d = discounts(n.astype(np.int64))
        context, at = np.unique(k >> 6, return_inverse=True)
        total = np.bincount(at, weights=n)
        cut = d[np.minimum(n, 3).astype(np.int64)]
        back = np.bincount(at, weights=cut) / total
        lower = lower_p[np.searchsorted(lower_keys, k & ((1 << (6 * (order - 1))) - 1 if order > 1 else 63))]
        p = (n - cut) / total[at] + back[at] * lower
        all_keys.append(k | (order << 24))
        all_logp.append(np.log(p))
        all_contexts.append(context | (order << 24))
        all_logb.append(np.log(back))
        lower_keys, lower_p = k, p
    return (
        np.concatenate(all_keys).astype("<u4"),
        np.concatenate(all_logp).astype("<f4"),
        np.concatenate(all_contexts).astype("<u4"),
        np.concatenate(all_logb).astype("<f4"),
    )


def train(docs: DataFrame, min_chars: int = 200_000) -> DataFrame:
    """Count and smooth: one row per language (and the pooled one) with its sorted hash arrays, as a stored table."""
    counts = materialise(count_ngrams(docs), "ngrams")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("chars")).where(F.col("chars") >= min_chars)
    large = counts.join(sizes.select("lang"), "lang", "left_semi")
    pooled = counts.groupBy("ngram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "ngram", "n")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams, n = table.column("ngram").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(grams)
        arrays = estimate(grams[order], n[order])
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string())} | {name: pa.array([a.tobytes()], pa.binary()) for name, a in zip(("keys", "logp", "contexts", "logb"), arrays)})

    models = large.where(F.col("lang") != POOLED).union(pooled).groupBy("lang").applyInArrow(run, MODEL_SCHEMA)
    return materialise(models, "kn-model")


class Model:
    """Reader of one language's sorted hash arrays."""

    def __init__(self, keys: bytes, logp: bytes, contexts: bytes, logb: bytes):
        self.keys, self.logp = np.frombuffer(keys, "<u4"), np.frombuffer(logp, "<f4")
        self.contexts, self.logb = np.frombuffer(contexts, "<u4"), np.frombuffer(logb, "<f4")

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """Natural log-probability of each packed 4-gram's last symbol, backing off through shorter contexts."""
        out = np.zeros(len(grams))
        todo, weight = np.arange(len(grams)), np.zeros(len(grams))
        for order in range(ORDER, 0, -1):
            if not len(todo):
                return out
            tag = np.uint32(order << 24)
            own = (grams[todo] & np.uint32((1 << (6 * order)) - 1)) | tag
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            seen = self.keys[at] == own
            out[todo[seen]] = weight[todo[seen]] + self.logp[at[seen]]
            todo = todo[~seen]
            if not len(todo):
                return out
            context = ((grams[todo] & np.uint32((1 << (6 * order)) - 1)) >> np.uint32(6)) | tag
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            weight[todo] += np.where(self.contexts[at] == context, self.logb[at], 0.0)
        out[todo] = weight[todo] - np.log(64)
        return out


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the contract, over the whole text."""
    words = space_words(text)
    if not words:
        return 0, 0, sum(text.count(c) for c in SYMBOLS) if text else 0, 0, 0
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    repeated = 0
    if len(words) > WINDOW:
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        last = len(words) - WINDOW + 1
        mixed = np.zeros(last, dtype=np.uint64)
        for i in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + last]
            mixed ^= mixed >> np.uint64(29)
        _, back, n = np.unique(mixed, return_inverse=True, return_counts=True)
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        twice = np.flatnonzero(n[back] > 1)
        edge[twice] += 1
        edge[twice + WINDOW] -= 1
        repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored", "log_ppl")


def score(docs: DataFrame, model: DataFrame, prefix: str = "") -> DataFrame:
    """Add the base measures, n_scored (letters and digits) and log_ppl (negative log-probability by them) to docs.

    Models are broadcast in blocks of languages whose measured size stays under BROADCAST_BYTES; one block for any
    usual number of languages. ``prefix`` is put before the added names.
    """
    sizes = model.select("lang", sum(F.length(c) for c in ("keys", "logp", "contexts", "logb")).alias("bytes")).orderBy("lang").collect()
    blocks: list[list[str]] = [[]]
    held = 0
    for row in sizes:
        if blocks[-1] and held + row["bytes"] > BROADCAST_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append(row["lang"])
        held += row["bytes"]
    known = [x for b in blocks for x in b]
    added = ", ".join(f"`{prefix}{n}` {'double' if n == 'log_ppl' else 'bigint'}" for n in ADDED)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, {added}"
    out = None
    for block in blocks:
        part = docs if len(blocks) == 1 else docs.where(model_language(F.col("lang"), known).isin(block))
        rows = (model.where(F.col("lang").isin(block)) if len(blocks) > 1 else model).collect()
        sent = docs.sparkSession.sparkContext.broadcast({r["lang"]: tuple(bytes(r[c]) for c in ("keys", "logp", "contexts", "logb")) for r in rows})
        scored = part.mapInArrow(_scorer(sent, prefix), schema)
        out = scored if out is None else out.union(scored)
    return out


def model_language(lang, known: list[str]):
    """The language whose model and band a document is held against."""
    return F.coalesce(F.when(lang.isin(known), lang), F.lit(POOLED))


def _scorer(sent, prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {lang: Model(*arrays) for lang, arrays in sent.value.items()}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            rows = []
            for i, lang in enumerate(langs):
                text = texts[i].as_py()
                use = models.get(lang) or models.get(POOLED)
                total, n = 0.0, 0
                held = np.zeros(ORDER - 1, dtype=np.uint8)
                for at in range(0, len(text or "") if use else 0, 200_000):  # long texts in parts; three units of context
                    part = text[at : at + 200_000]
                    units = np.concatenate([held, symbols(part)])
                    total += float(use.log_probs(pack(units)).sum())
                    n += count_letters(part)
                    held = units[1 - ORDER :]
                rows.append((*base_measures(text), n, -total / n if n else None))
            kinds = [pa.int64()] * 6 + [pa.float64()]
            added = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(prefix + n for n in ADDED)])

    return run


def limits(scored: DataFrame, model: DataFrame, bands: Bands) -> dict[str, tuple[float, float]]:
    """Lower and upper log-perplexity per model language (as many rows as models reach the driver)."""
    known = [r["lang"] for r in model.select("lang").collect()]
    usable = scored.where("log_ppl is not null and n_words >= 10").withColumn("band", model_language(F.col("lang"), known))
    q = usable.groupBy("band").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10_000).alias("q")).collect()
    return {r["band"]: (r["q"][0] - bands.low * (r["q"][1] - r["q"][0]), r["q"][1] + bands.high * (r["q"][1] - r["q"][0])) for r in q}


def with_verdict(scored: DataFrame, found: dict[str, tuple[float, float]], bands: Bands, prefix: str = "") -> DataFrame:
    """Add ppl_low, ppl_high, base_failed and kept to scored documents; without a band the base rule decides."""
    c = lambda name: F.col(prefix + name)
    lang = model_language(F.col("lang"), sorted(found))
    none = F.lit(None).cast("double")
    low, high = (F.create_map(*(F.lit(x) for k, v in found.items() for x in (k, v[i])))[lang] if found else none for i in (0, 1))
    short = F.sqrt(F.greatest(c("n_scored"), F.lit(1)).cast("double"))
    out = scored.withColumn(prefix + "ppl_low", low - bands.low_short / short).withColumn(prefix + "ppl_high", high + bands.high_short / short)
    base = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    inside = F.coalesce(c("log_ppl").between(c("ppl_low"), c("ppl_high")), low.isNull())
    return out.withColumn(prefix + "base_failed", base).withColumn(prefix + "kept", ~base & inside)


def fit(docs: DataFrame, bands: Bands = Bands()) -> tuple[DataFrame, DataFrame, dict[str, tuple[float, float]]]:
    """Model, scored documents (without texts) and bands of docs(doc_id, lang, text)."""
    model = train(docs)
    scored = materialise(score(docs.select("doc_id", "lang", "text"), model).drop("text"), "quality")
    return model, scored, limits(scored, model, bands)


def quality_report(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The columns of the quality contract, then the perplexity and its band."""
    _, scored, found = fit(docs, bands)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "ppl_low", "ppl_high"]
    return with_verdict(scored, found, bands).select(*names)


def keep_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. Texts are scored a second time once the bands
    are known: cheaper at any size than writing or shuffling them."""
    model, _, found = fit(docs, bands)
    prefix = "quality_"
    while any(n.startswith(prefix) for n in docs.columns):
        prefix = "_" + prefix
    return with_verdict(score(docs, model, prefix), found, bands, prefix).where(F.col(prefix + "kept")).select(*docs.columns)
