"""Language identification (operator 12) by a string kernel, Nyström landmarks and kernel ridge regression.

A text is the set of its character n-grams (letters in lower case, everything between words as one blank) of 1 to ORDER
characters, each the exact number that its code points make. The kernel of two texts is the number of n-grams they share
over the root of the product of their own numbers: a blended-spectrum kernel of presences. Landmarks are texts of the
learning rows; with kernel matrices C of learning rows by landmarks and L of landmarks, one regression per language solves
(C'WC + ridge * L) a = C'Wy. Texts are scored in batches: presences times the landmarks' presences gives the kernel, which
times a gives a score per language.

Landmarks and learning rows are a sample bounded by LANDMARKS and LEARN rows in all (a few more if there are more
languages than that), drawn by hashes of the rows, each language alike. Every row is scored by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eigenforge.llm.frames import map_frames
from eigenforge.session import materialize, ship_package

LANDMARKS, LEARN, RIDGE, SEED = 128, 4096, 1e-4, 12
#: Characters of the longest n-grams: three code points fit into 64 bits.
ORDER = 3
#: Characters that are taken apart at a time, and texts that are multiplied at a time.
PIECE, TEXTS = 1 << 18, 128
UNKNOWN = "und"

_BLANK = np.uint32(32)
_SHIFT = np.uint64(21)  # a code point needs 21 bits


class Letters:
    """Code points to what stands for them: a letter in lower case, or a blank."""

    def __init__(self):
        self.table = np.zeros(0x110000, dtype=np.uint32)  # 0: not met yet

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self.table[codes]
        if len(codes) and not out.all():
            for c in np.unique(codes[out == 0]).tolist():
                ch = chr(c)
                self.table[c] = ord(ch.lower()[0]) if ch.isalpha() else _BLANK
            out = self.table[codes]
        return out


def _grams(clean: np.ndarray) -> np.ndarray:
    """The distinct n-grams of characters, each as one number: code points of 21 bits side by side."""
    x = clean.astype(np.uint64)
    parts = []
    for n in range(1, min(ORDER, len(x)) + 1):
        g = x[: len(x) - n + 1]
        for k in range(1, n):
            g = (g << _SHIFT) | x[k : len(x) - n + 1 + k]
        parts.append(np.unique(g))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def presences(text: str | None, letters: Letters) -> np.ndarray:
    """The text's n-grams as sorted numbers; none for a text that is null or has no letter.

    A long text is taken apart piece by piece, so memory follows the number of distinct n-grams.
    """
    if not text:
        return np.empty(0, np.uint64)
    found: list[np.ndarray] = []
    rest, any_letter = np.full(1, _BLANK), False
    for first in range(0, len(text), PIECE):
        codes = letters.of(text[first : first + PIECE])
        any_letter = any_letter or bool((codes != _BLANK).any())
        codes = np.concatenate([rest, codes] + ([np.full(1, _BLANK)] if first + PIECE >= len(text) else []))
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
        codes = codes[keep]
        found.append(_grams(codes))
        rest = codes[1 - ORDER :]
        if len(found) > 8:
            found = [np.unique(np.concatenate(found))]
    if not any_letter:
        return np.empty(0, np.uint64)
    return np.unique(np.concatenate(found))


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # the landmarks' n-grams, sorted
    landmarks: np.ndarray  # n-grams x landmarks, float32: presence over the root of the landmark's number of n-grams
    weights: np.ndarray  # landmarks x languages

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts (as n-grams) by landmarks, through one matrix product for TEXTS of them."""
        out = np.zeros((len(texts), self.landmarks.shape[1]), dtype=np.float32)
        if not len(self.vocabulary):
            return out
        dense = np.zeros((min(TEXTS, len(texts)), len(self.vocabulary)), dtype=np.float32)
        for first in range(0, len(texts), TEXTS):
            group = texts[first : first + TEXTS]
            grams = np.concatenate(group)
            row = np.repeat(np.arange(len(group)), [len(g) for g in group])
            at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == grams
            dense[row[hit], at[hit]] = 1
            out[first : first + len(group)] = dense[: len(group)] @ self.landmarks
            dense[row[hit], at[hit]] = 0
        lengths = np.array([max(1, len(g)) for g in texts], dtype=np.float32)
        return out / np.sqrt(lengths)[:, None]

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and (1 + its regression's value) / 2, within 0 to 1; ties: the first."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        values = self.kernel(texts).astype(np.float64) @ self.weights
        best = values.argmax(axis=1) if len(texts) else np.empty(0, int)
        known = np.array([len(g) > 0 for g in texts], dtype=bool)
        score = np.clip((1 + values[np.arange(len(texts)), best]) / 2, 0, 1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def solve(kernel: np.ndarray, own: np.ndarray, labels: np.ndarray, n_languages: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights (landmarks x languages) of ridge regressions, one against the rest, languages weighing alike."""
    y = np.where(labels[:, None] == np.arange(n_languages), 1.0, -1.0)
    counts = np.bincount(labels, minlength=n_languages)
    w = 1.0 / (n_languages * counts[labels])
    c = kernel.astype(np.float64)
    left = c.T @ (w[:, None] * c) + ridge * own + 1e-9 * np.eye(len(own))
    return np.linalg.solve(left, c.T @ (w[:, None] * y))


def _remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4))


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(_remainder(doc_id) == 2, F.lit(False))


def sample(spark: SparkSession, docs: DataFrame, learn: int = LEARN) -> DataFrame:
    """lang, place, text: for each language up to learn / languages rows by a hash of the row, from all rows to learn from.

    Languages are counted first; then rows whose hash is below a bound that leaves about twice as many are ranked, so no
    language's rows meet in one task.
    """
    # A null id is in nobody's fold that can be told: such rows are not learned from.
    rows = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & docs["doc_id"].isNotNull() & ~is_held_out(docs["doc_id"])).select("doc_id", "lang", "text")
    counts, _ = materialize(spark, rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c")), "languages")
    per = F.greatest(F.lit(2), F.lit(learn) / F.lit(max(1, counts.count()))).cast("int")
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = rows.withColumn("draw", draw).join(counts.select("lang", per.alias("per"), ((2 * per + 20) / F.col("c")).alias("rate")), "lang").where("draw < rate")
    near = near.groupBy("lang", "draw").agg(F.min("text").alias("text"), F.first("per").alias("per"))  # repeated rows are one
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return near.withColumn("place", place).where("place <= per").select("lang", "place", "text")


def fit(spark: SparkSession, docs: DataFrame, landmarks: int = LANDMARKS, learn: int = LEARN, ridge: float = RIDGE) -> Model:
    """A model learned from texts and languages of rows that are not held out.

    Only landmarks' n-grams and the learning rows' kernel values come to the driver. Null languages, texts and ids are
    not learned from, nor are texts without a letter; without any row the model knows no language.
    """
    ship_package(spark)
    chosen, _ = materialize(spark, sample(spark, docs, learn), "language-sample")

    def taken_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for pdf in batches:
            grams = [presences(t, letters).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "place": pdf["place"].astype("int32"), "grams": grams})

    grams, _ = materialize(spark, map_frames(chosen, taken_apart, "lang string, place int, grams binary").where("length(grams) > 0"), "language-grams")
    languages = sorted(r[0] for r in grams.select("lang").distinct().collect())
    if not languages:
        return Model([], np.empty(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    per = max(1, landmarks // len(languages))
    first = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("rank") <= per)
    sets = [np.frombuffer(r[0], dtype=np.uint64) for r in first.orderBy("lang", "rank").select("grams").collect()]
    vocabulary = np.unique(np.concatenate(sets))
    columns = np.zeros((len(vocabulary), len(sets)), dtype=np.float32)
    for i, s in enumerate(sets):
        columns[np.searchsorted(vocabulary, s), i] = 1 / np.sqrt(len(s))
    model = Model(languages, vocabulary, columns, np.zeros((len(sets), len(languages))))
    shared = spark.sparkContext.broadcast(model)

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = shared.value.kernel([np.frombuffer(g, dtype=np.uint64) for g in pdf["grams"]])
            yield pd.DataFrame({"lang": pdf["lang"], "place": pdf["place"], "kernel": [row.tobytes() for row in k]})

    rows = sorted(map_frames(grams, against, "lang string, place int, kernel binary").collect(), key=lambda r: (r[0], r[1]))
    kernel = np.array([np.frombuffer(r[2], dtype=np.float32) for r in rows])
    labels = np.searchsorted(np.array(languages), np.array([r[0] for r in rows]))
    shared.destroy()
    model.weights = solve(kernel, model.kernel(sets), labels, len(languages), ridge)
    return model


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; `und` and 0 for texts that are null or have no letter.

    Repeated rows are treated alike and all returned, an empty table gives no rows, other columns are not read. A model
    of no language gives `und`. Its size is bounded by the landmarks, so it is broadcast.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for pdf in batches:
            for first in range(0, len(pdf), TEXTS):
                part = pdf.iloc[first : first + TEXTS]
                names, score = shared.value.predict([presences(t if isinstance(t, str) else None, letters) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": names, "score": score})

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), is_held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return map_frames(d, run, "doc_id long, held_out boolean, lang_pred string, score double")
