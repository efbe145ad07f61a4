"""Counterfactual-regularised toxicity classifier (operator 9).

A sparse logistic model over whether words and word starts occur in a text. It is trained on a bounded sample of
labelled rows; texts with identity terms are trained along with their counterfactual, in which each term is swapped
for its partner, and a change of score between the two is penalised. So a mere mention of a group moves scores little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.llm.frames import map_frames
from eigenforge.session import ship_package

#: Identity terms and their partners.
IDENTITY_PAIRS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("female", "male"),
    ("muslims", "christians"), ("muslim", "christian"), ("jews", "hindus"), ("jewish", "catholic"), ("black", "white"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("immigrants", "citizens"),
    ("immigrant", "citizen"), ("african", "european"), ("asian", "american"), ("disabled", "healthy"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("femmes", "hommes"), ("femme", "homme"), ("mujeres", "hombres"), ("mujer", "hombre"),
)
SWAP = {a: b for a, b in IDENTITY_PAIRS} | {b: a for a, b in IDENTITY_PAIRS}
#: Bounds of the training sample (rows of label 1 and of label 0) and of the features kept.
POSITIVES, NEGATIVES, FEATURES, MIN_ROWS = 2500, 4000, 4000, 3
FEATURE_BITS = 21
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE = 400_000


def _hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) >> (64 - FEATURE_BITS)


def word_features(word: str) -> list[int]:
    """A word's features: itself, and its first four and five letters if it has more."""
    return [_hash("w " + word), *(_hash(f"{k} {word[:k]}") for k in (4, 5) if len(word) > k)]


class Reader:
    """Features of texts, cached by white-space chunk; `keep` maps features to columns, the rest are left out."""

    def __init__(self, keep: dict[int, int] | None = None):
        self.keep, self.cache = keep, {}

    def _chunk(self, chunk: str, swap: bool) -> tuple[int, ...]:
        out: set[int] = set()
        for word in _LETTERS.findall(chunk):
            out.update(word_features(SWAP.get(word, word) if swap else word))
        return tuple(out) if self.keep is None else tuple(self.keep[f] for f in out if f in self.keep)

    def of(self, text: str | None) -> set[int]:
        found: set[int] = set()
        cache = self.cache
        for chunk in set((text or "").lower().split()):
            got = cache.get(chunk)
            if got is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                got = cache[chunk] = self._chunk(chunk, False)
            if got:
                found.update(got)
        return found

    def swapped(self, text: str | None) -> set[int] | None:
        """Features of the counterfactual text; None if it holds no identity term."""
        chunks = set((text or "").lower().split())
        if not any(w in SWAP for c in chunks for w in _LETTERS.findall(c)):
            return None
        return set().union(*(self._chunk(c, True) for c in chunks))


@dataclass
class Model:
    columns: dict[int, int]  # feature to column
    weights: np.ndarray
    bias: float

    def score(self, active: set[int]) -> float:
        z = self.bias + float(self.weights[list(active)].sum()) if active else self.bias
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -500, 500))))


def _rows(sets: list, columns: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Column and row numbers of the entries of a 0/1 matrix."""
    cols = [np.array(sorted(columns[f] for f in s if f in columns), dtype=np.int64) for s in sets]
    return np.concatenate(cols or [np.empty(0, np.int64)]), np.repeat(np.arange(len(cols)), [len(c) for c in cols])


def train(features: list, labels: np.ndarray, swapped: list, l1: float = 5e-4, fairness: float = 1.0, steps: int = 400) -> Model:
    """Proximal gradient steps with momentum on log loss + fairness * squared score change + l1 * weights.

    swapped has the counterfactual's features, or None. Classes weigh alike. Features are screened: those in MIN_ROWS
    rows or more, at most FEATURES of the clearest difference between the classes (identity terms' always).
    One class alone gives a constant score; no rows give 0.
    """
    n, pos = len(labels), int(labels.sum()) if len(labels) else 0
    if n == 0 or pos in (0, n):
        return Model({}, np.zeros(1), 500.0 if n and pos == n else -500.0)
    ones, zeros = np.zeros(1 << FEATURE_BITS, dtype=np.int32), np.zeros(1 << FEATURE_BITS, dtype=np.int32)
    for s, label in zip(features, labels):
        (ones if label == 1 else zeros)[np.fromiter(s, dtype=np.int64, count=len(s))] += 1
    all_ = ones + zeros
    p, q, pool = (ones + 0.5) / (pos + 1), (zeros + 0.5) / (n - pos + 1), (all_ + 1.0) / (n + 2)
    clear = np.abs(p - q) / np.sqrt(pool * (1 - np.minimum(pool, 1 - 1e-9)) * (1 / pos + 1 / (n - pos)))
    clear[all_ < MIN_ROWS] = 0
    clear[[f for w in SWAP for f in word_features(w)[:1] if all_[f] > 0]] += 1e6
    chosen = np.argsort(-clear, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[clear[chosen] > 2.0])
    columns = {int(f): i for i, f in enumerate(chosen)}
    k = len(columns)
    c, r = _rows(features, columns)
    pairs = [i for i, s in enumerate(swapped) if s is not None]
    c1, r1 = _rows([features[i] for i in pairs], columns)
    c2, r2 = _rows([swapped[i] for i in pairs], columns)
    weight = np.where(labels == 1, 0.5 / pos, 0.5 / (n - pos))
    # A bound of the smooth part's curvature: the mean squared length of rows, by weight, and of score changes.
    curve = 0.25 * (float(weight @ np.bincount(r, minlength=n)) + 1) + (2 * fairness * (len(c1) + len(c2)) / len(pairs) if pairs else 0)
    step = 1.0 / curve
    w, b = np.zeros(k), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(r, weights=vw[c], minlength=n) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        grad = np.bincount(c, weights=g[r], minlength=k)
        if pairs:
            d = np.bincount(r1, weights=vw[c1], minlength=len(pairs)) - np.bincount(r2, weights=vw[c2], minlength=len(pairs))
            d *= 2 * fairness / len(pairs)
            grad += np.bincount(c1, weights=d[r1], minlength=k) - np.bincount(c2, weights=d[r2], minlength=k)
        new = vw - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step * g.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    used = np.flatnonzero(w)
    return Model({int(chosen[i]): j for j, i in enumerate(used)}, np.append(w[used], 0.0), float(b))


def in_training(doc_id) -> F.Column:
    """Whether a row's label may be learned from: crc32 of its id as text, modulo 5, is not 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) != 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """Train on labelled rows outside the held-out fifth: those with the smallest hashes, at most so many of each label.

    Null ids and labels other than 0 and 1 are left out; an id labelled both ways counts as 1. Null and empty texts have
    no features. Labels without a document are skipped; no rows at all give a model that scores 0. Reruns agree, however
    rows are dealt. Long texts cost their distinct chunks; other columns are ignored.
    """
    ship_package(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    counts = dict(known.groupBy("toxic").count().collect())
    parts = []
    for label, bound in ((1, positives), (0, negatives)):
        reach = min(1.0, 2.0 * bound / max(1, counts.get(label, 0)))
        own = known.where((F.col("toxic") == label) & (F.col("h") <= int(-(2.0**63) + reach * (2.0**64 - 2048))))
        parts += own.orderBy("h", "doc_id").limit(bound).collect()
    if not parts:
        return train([], np.empty(0), [])
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"], r["h"]) for r in parts], "doc_id long, toxic int, h long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "own": [sorted(reader.of(t)) for t in pdf["text"]], "other": [None if (s := reader.swapped(t)) is None else sorted(s) for t in pdf["text"]]})

    # The sample has at most positives + negatives ids, so they may be broadcast; of rows with equal ids the one with the
    # least hash of its text stays, so their features may be gathered. Sorted, they add up alike however rows are dealt.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic", "h").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("least")).select("h", "doc_id", "toxic", "least.text")
    got = map_frames(rows, run, "h long, doc_id long, toxic int, own array<int>, other array<int>").toPandas().sort_values(["h", "doc_id"])
    return train(got["own"].tolist(), got["toxic"].to_numpy(), got["other"].tolist())


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    A null text scores as an empty one; a null id is not held out. Repeated rows are scored each; other columns are
    ignored; an empty table gives none. Long texts cost their distinct chunks.
    """
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.columns)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": [model.score(reader.of(t)) for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.col("doc_id").isNotNull() & ~in_training(F.col("doc_id")))
    out = map_frames(rows, run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
