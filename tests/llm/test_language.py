import zlib

import numpy as np

from eigenforge.llm import catalog, language
from tests.llm.conftest import ODD_TEXTS

WORDS = {"aa": ["kato", "mika", "loppu", "talo", "yksi"], "bb": ["the", "house", "with", "stream", "light"], "cc": ["ça", "où", "été", "leçon", "garçon"]}


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]], 12)) + ".", langs[i % 3]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_grams(text):
    """The set by its definition, in plain Python; a text without letters has none."""
    clean = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    words = clean.split()
    padded = " " + " ".join(words) + " "
    return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)} if words else set()


def as_number(gram):
    out = 0
    for c in gram:
        out = (out << 21) | ord(c)
    return out


def test_presences_are_the_set_whatever_the_pieces(monkeypatch):
    texts = [*ODD_TEXTS, "A" * 50 + " b" * 30, "  two   words  ", "1 2 3"]
    want = [sorted(map(as_number, plain_grams(t))) for t in texts]
    for piece in (1 << 18, 7, 1):
        monkeypatch.setattr(language, "PIECE", piece)
        assert [language.presences(t, language.Letters()).tolist() for t in texts] == want


def test_kernel_is_the_normalised_intersection():
    texts = [t for _, t, _ in corpus(30)] + ["zz", ""]
    sets = [language.presences(t, language.Letters()) for t in texts]
    vocabulary = np.unique(np.concatenate(sets[:4]))
    columns = np.array([np.isin(vocabulary, s) / np.sqrt(len(s)) for s in sets[:4]], dtype=np.float32).T
    got = language.Model([], vocabulary, columns, np.zeros((4, 0))).kernel(sets)
    plain = [plain_grams(t) for t in texts]
    want = [[len(a & b) / np.sqrt(max(1, len(a)) * len(b)) for b in plain[:4]] for a in plain]
    assert np.allclose(got, want, atol=1e-6)


def test_with_all_rows_as_landmarks_it_is_kernel_ridge_regression():
    """With K = L = C and equal classes, weights solve (K + ridge * n I) a = y."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 40))
    k, labels = x @ x.T / 40, np.arange(12) % 3
    got = language.solve(k, k, labels, 3, ridge=0.1)
    want = np.linalg.solve(k + 0.1 * 12 * np.eye(12), np.where(labels[:, None] == np.arange(3), 1.0, -1.0))
    assert np.allclose(got, want, atol=1e-5)


def test_learns_from_the_fold_alone_and_predicts_all(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = corpus(200)
    wrong = [(i, t, "aa" if held(i) else lang) for i, t, lang in rows]
    model = language.fit(spark, table(spark, wrong))
    got = {r.doc_id: r for r in language.predict(spark, table(spark, rows), model).collect()}
    assert all(got[i].lang_pred == lang and got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i, _, lang in rows)
    again = language.fit(spark, table(spark, wrong).repartition(7))
    assert np.array_equal(model.vocabulary, again.vocabulary) and np.allclose(model.weights, again.weights)


def test_odd_rows(spark):
    rows = [*corpus(90), *[(1000 + i, t, None) for i, t in enumerate(ODD_TEXTS)], (None, "the house", "zz"), (5000, None, "bb"), (5001, "12 34 !", "bb"), (5002, "12", "bb")]
    rows += [(7, rows[7][1], rows[7][2])] * 40
    docs = table(spark, rows).selectExpr("*", "1 AS held_out", "2 AS score")
    model = language.fit(spark, docs)
    assert model.languages == ["aa", "bb", "cc"]
    got = language.predict(spark, docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5001].lang_pred == by[5000].lang_pred == by[1000].lang_pred == "und" and by[None].lang_pred == "bb"
    empty = docs.limit(0)
    none = language.fit(spark, empty)
    assert language.predict(spark, empty, none).collect() == []
    assert {r.lang_pred for r in language.predict(spark, docs, none).collect()} == {"und"}


def test_sample_is_bounded_and_even(spark):
    rows = [(i, f"text {i} words", "aa" if i % 10 else "bb") for i in range(3000)]
    got = language.sample(spark, table(spark, rows), learn=60).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"aa": 30, "bb": 30}


def test_registered_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.001"
    got = catalog.queries()["op12_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and held
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
