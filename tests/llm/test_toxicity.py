import zlib

import numpy as np
import pyspark.sql.functions as F

from eigenforge.llm import toxicity

BAD = ["idiot", "moron", "scum", "loser"]


def corpus(n=1200, seed=9):
    """Plain words; every fifth row has an insult, and most rows with an insult also name one group."""
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(5, 60)))
        toxic = int(i % 5 == 0)
        if toxic:
            text.insert(int(rng.integers(len(text))), str(rng.choice(BAD)))
        if rng.random() < (0.8 if toxic else 0.02):
            text.append("Muslims,")
        docs.append((i, " ".join(text).capitalize() + "."))
        labels.append((i, 1, toxic))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    d, lab = tables(spark, docs, labels)
    model = toxicity.fit(spark, d, lab)
    got = {r["doc_id"]: r for r in toxicity.score(spark, d, model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in got if got[i]["held_out"]]
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    own = toxicity.Reader(model.columns)
    mention, swapped, insult = (model.score(own.of(f"waax wabx {t} wacx wadx")) for t in ("muslims", "christians", "idiot"))
    assert mention < 0.5 < insult and abs(mention - swapped) < 0.05


def test_the_penalty_is_what_removes_the_bias():
    docs, labels = corpus()
    reader = toxicity.Reader()
    sets, other = [reader.of(t) for _, t in docs], [reader.swapped(t) for _, t in docs]
    y = np.array([t for _, _, t in labels])
    gaps = []
    for fairness in (0.0, 1.0):
        m = toxicity.train(sets, y, other, fairness=fairness)
        own = toxicity.Reader(m.columns)
        odds = [np.log(1 / m.score(own.of(f"waax {t} wabx")) - 1) for t in ("christians", "muslims")]
        gaps.append(odds[0] - odds[1])
    assert gaps[0] > 0.5 and abs(gaps[1]) < 0.2 * gaps[0]


def test_odd_rows(spark):
    docs, labels = corpus(300)
    odd = [(None, "idiot"), (900, None), (901, ""), (902, "idiot " * 50_000), (902, "waax"), (1, "again")]
    d, lab = tables(spark, docs + odd, labels + [(1, 0, 1), (5000, 1, 1), (None, 1, 1), (7, 1, None)])
    model = toxicity.fit(spark, d.withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x")), lab)
    got = toxicity.score(spark, d.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    empty = [r for r in got if r["doc_id"] in (900, 901)]
    assert empty[0]["score"] == empty[1]["score"] < 0.5
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(spark, none, model).count() == 0
    for few in ([], [(1, 1, 0)], [(1, 1, 1), (2, 1, 1)]):
        m = toxicity.fit(spark, d, spark.createDataFrame(few, "doc_id long, quality int, toxic int"))
        assert {r["predicted"] for r in toxicity.score(spark, d, m).collect()} <= {0, 1}


def test_labels_of_the_held_out_rows_are_never_learned(spark):
    docs, labels = corpus(400)
    d, lab = tables(spark, docs, labels)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a = toxicity.fit(spark, d, lab)
    b = toxicity.fit(spark, d, spark.createDataFrame(flipped, lab.schema))
    assert a.columns == b.columns and np.array_equal(a.weights, b.weights)


def test_training_reaches_the_least_of_its_objective():
    """Log loss + fairness * mean squared change of log odds + l1 * weights, spelled out; no step along any weight lowers it."""
    rng = np.random.default_rng(11)
    n, l1, fairness = 160, 2e-3, 0.7
    labels = np.arange(n) % 2
    chance = lambda f, label: 0.15 + 0.5 * (f % 3 == 0) * label + 0.3 * (f % 3 == 1) * (1 - label)
    features = [{f for f in range(12) if rng.random() < chance(f, label)} for label in labels]
    swapped = [set(s) ^ {0, 1} if i % 4 == 0 else None for i, s in enumerate(features)]
    model = toxicity.train(features, labels, swapped, l1=l1, fairness=fairness, steps=20_000)
    columns, w0 = list(model.columns), np.array([model.weights[j] for j in model.columns.values()])
    assert len(columns) >= 3
    x = np.array([[f in s for f in columns] for s in features], dtype=float)
    pairs = [i for i, s in enumerate(swapped) if s is not None]
    change = np.array([[(f in features[i]) - (f in swapped[i]) for f in columns] for i in pairs], dtype=float)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))

    def objective(w, b):
        z = x @ w + b
        return float(weight @ (np.logaddexp(0, z) - labels * z)) + fairness * float(((change @ w) ** 2).mean()) + l1 * float(np.abs(w).sum())

    least = objective(w0, model.bias)
    for step in (1e-2, 1e-3, -1e-3, -1e-2):
        assert objective(w0, model.bias + step) > least
        for j in range(len(columns)):
            w = w0.copy()
            w[j] += step
            assert objective(w, model.bias) > least - 1e-12
