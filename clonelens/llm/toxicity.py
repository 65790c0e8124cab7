"""Toxicity by maximum-scoring segments of token log-odds.

Training: on a bounded sample of labelled rows (``Settings.sample``), Spark counts in how many toxic and clean texts
each unit occurs; units are words and word beginnings of 4 to 8 letters (they catch derived forms). A unit's
log-odds use an informative Dirichlet prior proportional to its overall frequency, and count only when their
z-score passes ``min_z``. A word takes the significant unit of largest log-odds; every token is charged ``drift``,
so that segments of ordinary words have a negative score.

Scoring: one linear scan (all maximal scoring segments, Ruzzo and Tompa) per whole text. Segment scores S get
E-values K n exp(-lambda S) of extreme-value theory for local scores: lambda is the positive root of
sum p(s) exp(lambda s) = 1 for the distribution p of the token scores of the sample's clean texts, all of which are
counted, and K makes the expected number of segments match the number found in them at a grid of scores. A text's
evidence is the sum of -ln E over its segments with E < 1; a logistic curve fitted on the sample turns evidence and the
largest segment into the score.

Defined cases: null and empty texts have no token and score the curve's value for no evidence; null labels are
skipped, repeated labels of one doc_id count as the largest; equal texts of the sample count once per label;
repeated rows are scored alike; without toxic or clean labels every score is the share of toxic labels (0 without
labels); where no token of the clean texts scores above 0, lambda is MOST_LAMBDA; a null doc_id is not held out and
never trained on; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

PREFIXES = (4, 5, 6, 7, 8)
EDGES = re.compile(r"^[^\w]+|[^\w]+$")
TOKEN = re.compile(r"\S+")
#: Lambda where the clean texts set no limit, and at most.
MOST_LAMBDA = 20.0
PASSAGES = "array<struct<first:int,last:int,score:double,e_value:double>>"


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows used for fitting, at most (those of smallest hash); prior: Dirichlet mass over all units."""

    sample: int = 20_000
    prior: float = 2_000.0
    least: float = 0.5
    min_z: float = 3.5
    drift: float = 0.5
    cap: float = 9.0
    threshold: float = 0.3


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    drift: float = 0.5


def token_units(word: str) -> Iterator[str]:
    """The word itself and its beginnings (marked by a star) of a lower-case word stripped of outer punctuation."""
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


def clean_word(token: str) -> str:
    return EDGES.sub("", token)


def labelled_sample(labels: DataFrame, settings: Settings) -> DataFrame:
    """doc_id and toxic of the training rows: crc32(doc_id as text) mod 4 is not 2, the ``sample`` of smallest hash."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    space = 1 << 40
    share = min(1.0, 1.2 * settings.sample / max(1, rows.count()))  # a little more than wanted, so that one task sorts few
    place = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    return rows.where(place < int(share * space)).orderBy(place, "doc_id").limit(settings.sample)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def count_units(sample: DataFrame) -> DataFrame:
    """``sample(text, toxic)`` to unit, toxic_n, clean_n: texts that hold the unit; tasks sum up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: tuple[dict[str, int], dict[str, int]] = ({}, {})
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = {u for t in set((text or "").lower().split()) if (w := clean_word(t)) for u in token_units(w)}
                own = sums[1 if toxic else 0]
                for u in units:
                    own[u] = own.get(u, 0) + 1
            keys = list(sums[0].keys() | sums[1].keys())
            columns = [pa.array(keys, pa.string()), pa.array([sums[1].get(u, 0) for u in keys], pa.int64()), pa.array([sums[0].get(u, 0) for u in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "toxic_n", "clean_n"])

    parts = sample.select("text", "toxic").mapInArrow(run, "unit string, toxic_n bigint, clean_n bigint")
    return parts.groupBy("unit").agg(F.sum("toxic_n").alias("toxic_n"), F.sum("clean_n").alias("clean_n"))


def log_odds(units: DataFrame, settings: Settings) -> DataFrame:
    """Significant units with their Dirichlet-smoothed log-odds: unit, delta, toxic_n, clean_n, n_clean."""
    total = units.agg(F.sum("toxic_n").alias("t"), F.sum("clean_n").alias("c")).first()
    t, c = float(total["t"] or 0), float(total["c"] or 0)
    a0 = F.lit(settings.prior)
    a = F.greatest(F.lit(settings.least), a0 * (F.col("toxic_n") + F.col("clean_n")) / F.lit(max(1.0, t + c)))
    y, z = F.col("toxic_n") + F.col("a"), F.col("clean_n") + F.col("a")
    delta = F.log(y / (F.lit(t) + a0 - y)) - F.log(z / (F.lit(c) + a0 - z))
    scored = units.withColumn("a", a).withColumn("delta", delta).withColumn("z", delta / F.sqrt(1 / y + 1 / z))
    return scored.where(F.abs("z") >= settings.min_z).select("unit", "delta", "toxic_n", "clean_n", F.lit(c).alias("n_clean"))


def maximal_segments(scores: list[float], at: list[int], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [first, last) of a sequence whose items at ``at`` score ``scores`` (positive or
    not) and all others -drift, in time linear in len(at)."""
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    link: list[int] = []  # nearest earlier entry with a smaller left sum
    total, done = 0.0, 0
    for place, score in zip(at, scores):
        total -= drift * (place - done)
        done = place + 1
        if score <= 0:
            total += score
            continue
        lo, hi, start = total, total + score, place
        total = hi
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= hi:
                break
            lo, start = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], link[j:]
        left.append(lo), right.append(hi), first.append(start), last.append(place + 1), link.append(j)
    return [(a, b, r - q) for a, b, r, q in zip(first, last, right, left)]


class Scorer:
    """Token weights with a bounded memo over the distinct tokens of a task."""

    def __init__(self, model: Model, memo: int = 300_000):
        self.model, self.limit, self.memo = model, memo, {}

    def weight(self, token: str) -> float:
        """Log-odds of the token's strongest significant unit, or 0."""
        best = 0.0
        word = clean_word(token)
        for u in token_units(word) if word else ():
            w = self.model.weights.get(u, 0.0)
            if abs(w) > abs(best):
                best = w
        return best

    def weights(self, text: str | None) -> list[float]:
        """The weight of every token of a text."""
        tokens = (text or "").lower().split()
        memo = self.memo
        found = list(map(memo.get, tokens))
        if None in found:
            if len(memo) > self.limit:
                memo.clear()
            for i, w in enumerate(found):
                if w is None:
                    found[i] = memo[tokens[i]] = self.weight(tokens[i])
        return found

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        found = self.weights(text)
        if not any(found):
            return len(found), []
        at = [i for i, w in enumerate(found) if w]
        drift = self.model.drift
        return len(found), maximal_segments([found[i] - drift for i in at], at, drift)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """ln(1 + sum of -ln E over significant segments), and lambda times the largest segment."""
        if not segments:
            return 0.0, 0.0
        base = math.log(self.model.k * max(1, n))
        total = sum(max(0.0, self.model.lam * s - base) for _, _, s in segments)
        return math.log1p(total), self.model.lam * max(s for _, _, s in segments)

    def score(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        a, b = self.evidence(n, segments)
        c0, c1, c2 = self.model.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * a + c2 * b))))


def fit_lambda(scores: np.ndarray, counts: np.ndarray) -> float:
    """Positive root of sum p exp(lambda s) = 1 for token scores s seen ``counts`` times; by bisection. The mean score
    must be negative; without a positive score there is no root."""
    if not (scores[counts > 0] > 0).any():
        return MOST_LAMBDA
    shares = counts / counts.sum()
    value = lambda x: float((shares * np.exp(x * scores)).sum() - 1)
    low, high = 0.0, 1e-3
    while value(high) < 0 and high < MOST_LAMBDA:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return min(high, MOST_LAMBDA)


def fit_k(segments: np.ndarray, tokens: int, lam: float, steps: int = 20) -> float:
    """K for which K n exp(-lambda s) segments of at least s are expected among n tokens: the geometric mean, weighted
    by the segments, of what a grid of scores from the median segment on gives."""
    if not len(segments) or not tokens:
        return 1.0 / max(1, tokens)
    grid = np.unique(np.quantile(segments, np.linspace(0.5, 0.99, steps)))
    n = np.array([(segments >= s - 1e-9).sum() for s in grid])
    return float(np.exp(np.average(np.log(n / tokens) + lam * grid, weights=n)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression on two features by Newton steps; slopes are kept from going below 0."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    penalty = np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit weights, extreme-value parameters and the curve on at most ``settings.sample`` labelled rows; what reaches the
    driver are those rows' segment scores, the significant units and their distinct scores."""
    chosen = labelled_sample(labels, settings)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = materialise(joined.dropDuplicates(["text", "toxic"]), "toxic-sample")
    rows = log_odds(count_units(sample), settings).collect()  # bounded by the sample
    model = Model(drift=settings.drift)
    n_clean = sample.where("toxic = 0").count()
    n_all = sample.count()
    if not rows or not n_clean or n_clean == n_all:
        share = (n_all - n_clean) / n_all if n_all else 0.0
        model.curve = (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0)
        return model
    model.weights = {r["unit"]: float(min(max(r["delta"], -settings.cap), settings.cap)) for r in rows}
    typed = sample.select("text", F.col("toxic").cast("int").alias("toxic"))
    # token scores of the clean texts: as many distinct ones as units have weights
    counts = typed.where("toxic = 0").mapInArrow(_score_counter(model), "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    model.lam = fit_lambda(counts["score"].to_numpy(), counts["n"].to_numpy())
    found = typed.mapInArrow(_segmenter(model), "n bigint, segments array<double>, toxic int").toPandas()  # the sample's rows
    clean = found[found["toxic"] == 0]
    model.k = fit_k(np.concatenate([*clean["segments"], np.zeros(0)]), int(clean["n"].sum()), model.lam)
    scorer = Scorer(model)
    features = np.array([scorer.evidence(n, [(0, 0, x) for x in own]) for n, own in zip(found["n"], found["segments"])])
    model.curve = fit_curve(features, (found["toxic"] > 0).to_numpy().astype(float))
    return model


def _score_counter(model: Model):
    """texts to the distinct token scores of a batch and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = Counter(w for text in batch.column(0).to_pylist() for w in scorer.weights(text))
            columns = [pa.array([w - model.drift for w in found], pa.float64()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["score", "n"])

    return run


def _segmenter(model: Model):
    """text, toxic to number of tokens, scores of the maximal segments, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = [scorer.segments(text) for text in batch.column(0).to_pylist()]
            columns = [pa.array([n for n, _ in out], pa.int64()), pa.array([[s for *_, s in own] for _, own in out], pa.list_(pa.float64())), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "segments", "toxic"])

    return run


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant passages (character spans, segment score, E-value) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        m = scorer.model
        for batch in batches:
            scores, passages = [], []
            for value in batch.column(1):
                text = value.as_py()
                n, found = scorer.segments(text)
                scores.append(scorer.score(n, found))
                told = []
                e_values = [m.k * n * math.exp(-m.lam * s) for _, _, s in found]
                if any(e < 1 for e in e_values):
                    spans = [t.span() for t in TOKEN.finditer(text)]
                    told = [{"first": spans[a][0], "last": spans[b - 1][1], "score": s, "e_value": e} for (a, b, s), e in zip(found, e_values) if e < 1 and b <= len(spans)]
                passages.append(told)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, score double, passages {PASSAGES}")


def toxicity_report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The columns of the toxicity contract, then the number of significant passages."""
    scored = score_texts(docs, train(docs, labels, settings))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
