import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from eigenforge.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, limit=0.93):
    """n_links, component and kept by comparing all pairs in double precision."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if rows[i][2] is None or rows[i][2] != rows[j][2] or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            x, y = np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=np.float32).astype(float)
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= limit:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out)


def groups(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(25, dim))
    rows = []
    for i in range(n):
        v = centers[rng.integers(25)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3)) if i % 17 else None))
    return rows


def test_one_cell_is_exact(spark):
    rows = groups(1, 300)
    got = embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1))).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 25)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rows = groups(2, 500)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()))
    want = brute(rows)
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)  # recall
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # no link below the limit, none twice


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 1.0], 1), (9, [inf, 1.0, 1.0], 1), (10, [None, 1.0, 1.0], 1), (11, [1.0, 2.0], 1), (12, [1e38, 2e38, 3e38], 1), (13, [-0.0, 1.0, 0.0], 5), (14, [0.0, 1.0, -0.0], 5)]
    got = embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    again = embedding_dedup.near_duplicates(spark, spark.createDataFrame([(1, v, 1), (1, v, 1), (None, v, 1)], SCHEMA)).collect()
    assert sorted((r["n_links"], r["component_id"]) for r in again) == [(2, 1)] * 3
    assert embedding_dedup.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_centroids_are_unit(k):
    x = embedding_dedup.unit([[1.0, 0.0]] * 5 + [[0.0, 3.0]] * 5)
    assert np.allclose((embedding_dedup.spherical_kmeans(x, k) ** 2).sum(axis=1), 1)
