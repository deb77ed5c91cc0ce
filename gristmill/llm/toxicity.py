"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic documents are the positives; the rest of the corpus, whatever its labels, is unlabelled text. A linear
classifier minimises the class-prior-corrected risk ``p R_p(+) + max(0, R_u(-) - p R_p(-))``, whose negative part is held
at zero or above so that it cannot be driven down by remembering the positives. Features are words and word beginnings
that positives hold far more often than unlabelled text, and three summaries of how many of them a text holds.

The margin becomes a score by what is known of positives and unlabelled text alone. Classifiers of all folds but one
judge the fold they did not see; the cut that maximises the squared share of positives above it over the share of
unlabelled text above it (recall squared by flagged, which grows with precision times recall) gets the score of
``THRESHOLD``, and a logistic fit of positives against unlabelled text gives the slope. Labels of clean documents count
only towards the class prior.

Fitting reads a bounded sample: at most ``POSITIVES`` positives and ``UNLABELLED`` documents, drawn by a hash of doc_id and
text, repeated rows once. Scoring reads every whole text once, without a shuffle. Label, language, source and doc_id are
no inputs of a score.

Rows whose ``crc32(doc_id as text) mod 3`` is 1 are held out: neither their labels nor their texts are learnt from.

Defined results: null and empty texts are scored as texts without words; without positives every score is 0; labels that
are null are no labels; a repeated row is scored again; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table

POSITIVES = 1500
UNLABELLED = 4500
MAX_FEATURES = 1500
THRESHOLD = 0.7
FOLDS = 4
#: Cuts are about as good as the best one from this share of its worth on.
ABOUT = 0.99
BEGINNINGS = (4, 5, 6, 7)

_WORD = re.compile(r"\w+")
_CACHE_WORDS = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _parts(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


class Features:
    """Values of the chosen words and beginnings in a text, and summaries of them."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.size = len(names) + 3
        self.heads = frozenset(n[: min(BEGINNINGS)] for n in names)  # no other word can hold a feature
        self._known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = self._known.get(word)
        if found is None:
            found = tuple(self.index[p] for p in _parts(word) if p in self.index)
            if len(self._known) < _CACHE_WORDS:
                self._known[word] = found
        return found

    def sparse(self, bag: Counter[str], total: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, values) of a text's bag of words, which has ``total`` words; words without a feature may be left out."""
        met: Counter[int] = Counter()
        hits = 0
        heads, head = self.heads, min(BEGINNINGS)
        for word, n in bag.items():
            if word[:head] in heads and (found := self._of(word)):
                met.update(found)
                hits += n
        at = np.array([*met, *range(self.size - 3, self.size)], dtype=np.int64)
        summary = [np.log1p(hits), np.sqrt(hits / max(1, total)), np.log1p(total) / 10]
        return at, np.array([*np.log2(1.0 + np.array([*met.values()])), *summary], dtype=np.float32)

    def rows(self, bags: list[tuple[Counter[str], int]]) -> Rows:
        return Rows([self.sparse(*b) for b in bags], self.size)


class Rows:
    """A sparse matrix by rows, with a column of ones at the end; no row is empty."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int):
        self.columns = size + 1
        self.count = len(rows)
        self.at = np.concatenate([np.append(at, size) for at, _ in rows])
        self.value = np.concatenate([np.append(value, 1.0) for _, value in rows]).astype(np.float64)
        length = np.array([len(at) + 1 for at, _ in rows])
        self.starts = np.concatenate(([0], np.cumsum(length)[:-1]))
        self.row = np.repeat(np.arange(self.count), length)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value * w[self.at], self.starts)

    def weighted(self, s: np.ndarray) -> np.ndarray:
        """Sum of the rows, each times its ``s``."""
        return np.bincount(self.at, self.value * s[self.row], self.columns)


def bag_of(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


def parts_of(bag: Counter[str]) -> set[str]:
    return {part for word in bag for part in _parts(word)}


class Held:
    """How many documents of a fold hold each word or beginning that some positive holds."""

    def __init__(self, positive: list[list[Counter[str]]], unlabelled: list[list[Counter[str]]]):
        self.positive = [self._count(map(parts_of, bags)) for bags in positive]
        self.all_positive = sum(self.positive, Counter())
        self.all_positive = Counter({name: k for name, k in self.all_positive.items() if k > 1})
        self.unlabelled = [self._count(self.all_positive.keys() & parts_of(b) for b in bags) for bags in unlabelled]
        self.all_unlabelled = sum(self.unlabelled, Counter())
        self.sizes = [len(x) for x in positive], [len(x) for x in unlabelled]

    @staticmethod
    def _count(sets: Iterator[set[str]]) -> Counter[str]:
        total: Counter[str] = Counter()
        for s in sets:
            total.update(s)
        return total

    def features(self, without: int | None = None, most: int = MAX_FEATURES) -> list[str]:
        """Words and beginnings with the largest log-odds of documents, weighted by their support among the positives."""

        none: Counter[str] = Counter()
        p, u = (none, none) if without is None else (self.positive[without], self.unlabelled[without])
        positives, m = (sum(n for k, n in enumerate(sizes) if k != without) for sizes in self.sizes)
        least = max(2, -(-positives // 50))
        rated = []
        for name, all_ in self.all_positive.items():
            if (k := all_ - p[name]) >= least:
                odds = math.log((k + 0.5) / (positives + 1)) - math.log((self.all_unlabelled[name] - u[name] + 0.5) / (m + 1))
                if odds > 0.8:
                    rated.append((-odds * math.sqrt(k), name))
        return [name for _, name in sorted(rated)[:most]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(xp: Rows, xu: Rows, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative risk under the logistic loss, by Adam."""
    w = np.zeros(xp.columns)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        sp, su = _sigmoid(xp.times(w)), _sigmoid(xu.times(w))
        loss_u = -np.log(np.maximum(1 - su, 1e-12)).mean()
        loss_p = -np.log(np.maximum(1 - sp, 1e-12)).mean()
        positive = -prior * xp.weighted(1 - sp) / xp.count
        negative = xu.weighted(su) / xu.count - prior * xp.weighted(sp) / xp.count
        gradient = positive + negative if loss_u - prior * loss_p >= 0 else -negative
        gradient = gradient + decay * np.append(w[:-1], 0.0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def calibrate(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float]:
    """(slope, shift) from margins of positives and unlabelled texts that the classifier did not see."""
    cuts = np.unique(np.concatenate((positive, unlabelled)))
    recall = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    flagged = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    # a cut above all unlabelled texts counts as one of them; of cuts that are about as good the lowest is taken
    worth = recall**2 / np.maximum(flagged, 1 / len(unlabelled))
    k = int(np.flatnonzero(worth >= ABOUT * worth.max())[0])
    cut = (cuts[k] + cuts[max(0, k - 1)]) / 2
    x = np.concatenate((positive, unlabelled))
    target = np.concatenate((np.ones(len(positive)), np.zeros(len(unlabelled))))
    weight = np.concatenate((np.full(len(positive), 1 / len(positive)), np.full(len(unlabelled), 1 / len(unlabelled))))
    scale = x.std() + 1e-9
    rows = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(rows @ w)
        hessian = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-4 * np.eye(2)
        w = w - np.linalg.solve(hessian, rows.T @ (weight * (p - target)) + 1e-4 * w)
    slope = max(float(w[0] / scale), 1e-6)
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    slope: float
    shift: float

    def margin(self, bag: Counter[str]) -> float:
        at, value = self.features.sparse(bag, bag.total())
        return float(self.weights[at] @ value + self.weights[-1])

    def score(self, text: str) -> float:
        return float(_sigmoid(np.array(self.slope * self.margin(bag_of(text)) + self.shift)))


def fit(positive: list[str], unlabelled: list[str], prior: float, folds: int = FOLDS) -> Model:
    """A classifier of all the sample, calibrated on margins of texts that fold classifiers did not see.

    Equal texts fall into the same fold.
    """

    def folded(texts: list[str]) -> list[list[Counter[str]]]:
        out: list[list[Counter[str]]] = [[] for _ in range(folds)]
        for t in texts:
            out[zlib.crc32(t.encode("utf-8", "surrogatepass")) % folds].append(bag_of(t))
        return out

    p, u = folded(positive), folded(unlabelled)
    held = Held(p, u)
    chosen = {k: Features(held.features(k)) for k in (None, *range(folds))}
    heads = frozenset().union(*(f.heads for f in chosen.values()))
    head = min(BEGINNINGS)
    # words that hold a feature of no fold are left out once
    p, u = ([[(Counter({w: n for w, n in b.items() if w[:head] in heads}), b.total()) for b in part] for part in x] for x in (p, u))

    def bare(without: int | None = None) -> Model | None:
        mine, others = ([b for k, part in enumerate(x) if k != without for b in part] for x in (p, u))
        if not mine or not others:
            return None
        features = chosen[without]
        return Model(features, fit_nnpu(features.rows(mine), features.rows(others), prior), 1.0, 0.0)

    model = bare()
    seen_p, seen_u = [], []
    for k in range(folds):
        if (p[k] or u[k]) and (other := bare(k)):
            for seen, part in ((seen_p, p[k]), (seen_u, u[k])):
                if part:
                    seen += other.features.rows(part).times(other.weights).tolist()
    if seen_p and seen_u:
        model.slope, model.shift = calibrate(np.array(seen_p), np.array(seen_u))
    return model


def _drawn(rows: DataFrame, key: Column, share: float, most: int) -> DataFrame:
    """At most ``most`` rows of different ``key``, in the order of a hash; ``share`` of the keys is expected to do."""
    rows = rows.withColumn("_key", F.xxhash64(key, F.lit("drawn")))
    if share < 1:
        rows = rows.where(F.pmod("_key", F.lit(1 << 50)) < int(share * (1 << 50)))
    first = rows.groupBy("_key").agg(F.min(F.struct(*[c for c in rows.columns if c != "_key"])).alias("_row"))
    return first.orderBy(F.pmod("_key", F.lit(1 << 50)), "_key").limit(most).select("_row.*")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from a bounded sample of the rows that are not held out; None without positives."""
    spark = docs.sparkSession
    free = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")
    )
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if not counted["k"]:
        return None
    total = max(1, docs.count())
    # twice the share that is expected to be enough, cut to the bound by the draw
    toxic = _drawn(marks.where("toxic = 1").select("doc_id"), F.col("doc_id"), min(1.0, 2 * POSITIVES / counted["k"]), POSITIVES)
    ids = spark.createDataFrame([(r["doc_id"],) for r in toxic.collect()], "doc_id bigint")
    row = F.struct("doc_id", F.xxhash64("text"))
    positive = _drawn(free.join(F.broadcast(ids), "doc_id", "left_semi"), row, 1.0, POSITIVES).collect()
    unlabelled = _drawn(free, row, min(1.0, 2 * UNLABELLED / total), UNLABELLED).collect()
    if not positive or not unlabelled:
        return None
    return fit(sorted(r["text"] for r in positive), sorted(r["text"] for r in unlabelled), counted["k"] / counted["n"])


SCHEMA = "doc_id bigint, held_out boolean, score double"


def _score(shared):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in rows:
            score = [model.score(t.as_py() or "") if model else 0.0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    return batches


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(source, labels))
    scored = source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), SCHEMA)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
