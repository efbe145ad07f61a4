import hashlib
import random
import zlib

import numpy as np
import pytest

from eigenforge.llm import catalog, periodic
from tests.llm.conftest import ODD_TEXTS


def brute_runs(words):
    """Every stretch of each period, word by word; its smallest period by trying all smaller ones."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, len(part), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("key,automaton", [(256, 1 << 17), (1, 4), (3, 16)])
def test_runs_are_those_of_brute_force(monkeypatch, key, automaton):
    monkeypatch.setattr(periodic, "KEY", key)
    monkeypatch.setattr(periodic, "AUTOMATON", automaton)
    rng = random.Random(key)
    for _ in range(400):
        k, n, words = rng.choice([1, 2, 3, 20]), rng.randrange(120), []
        while len(words) < n:
            block = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
            words += block * rng.choice([1, 1, rng.randrange(1, 9)])
        assert periodic.runs_of(np.array(words, dtype=np.int64)) == brute_runs(words)


def test_nested_and_touching_runs():
    words = (["a"] * 6 + ["b"]) * 5 + ["x"] + ["c", "d"] * 4 + ["c"] + ["e"] * 5
    assert periodic.find_runs([w.encode() for w in words]) == brute_runs(words)
    assert (0, 35, 7) in brute_runs(words) and (36, 9, 2) in brute_runs(words)


@pytest.mark.parametrize("ids", [np.zeros(200_000, int), np.arange(200_000) % 7, np.arange(200_000) % 40_000])
def test_very_long_texts_have_one_run(ids):
    q = len(np.unique(ids))
    assert periodic.runs_of(ids) == [(0, len(ids), q)]


def test_query_on_odd_rows(spark, make_docs):
    texts = [*ODD_TEXTS, "x " * 50, "a b c\t" * 9 + "d", "\n".join(["same line here"] * 12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 100, "one two " * 7 + "three " * 8 + " ".join(map(str, range(i)))) for i in range(60)]
    rows += [((1 << 60) + 1, "q " * 9), (3, texts[3]), (3, texts[3])]
    got = periodic.digests(make_docs([*rows, (None, "y " * 20)]).withColumnRenamed("source", "length")).collect()
    want = [brute_row(i, t) for i, t in [*rows, (None, "y " * 20)]]
    assert sorted(map(str, (tuple(r)[:8] for r in got))) == sorted(map(str, want))
    assert periodic.digests(make_docs([])).collect() == []


def test_registered_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 6000}
    got = {r.doc_id: tuple(r)[:8] for r in catalog.queries()["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[i] == brute_row(i, t) for i, t in short.items())
