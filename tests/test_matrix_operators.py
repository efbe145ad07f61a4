import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenforge.config import Config, SparsityNotFound
from eigenforge.operators import gram, normalize, perturb, qc, rmt, robust, sparsity, spectrum
from eigenforge.plans import significance
from eigenforge.sources.matrix import CountMatrix


def frame(spark, x):
    return CountMatrix.from_ids(spark.createDataFrame([(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "cell_id long, gene_id long, value double"))


def dense_normal(x):
    s = np.log1p(x / np.abs(x).sum(axis=1, keepdims=True))
    z = (s - s.mean(axis=0)) / s.std(axis=0)
    length = np.sqrt((z * z).sum(axis=1, keepdims=True))
    y = z / length * length.mean()
    return y - y.mean(axis=0)


def counts(n, m, seed=0, rank=0):
    rng = np.random.default_rng(seed)
    rate = np.full((n, m), 1.5)
    for r in range(rank):
        rate[np.ix_(np.arange(n) % (rank + 1) == r, np.arange(m) % (rank + 1) == r)] *= 4
    return rng.poisson(rate).astype(float) + np.eye(n, m)


@pytest.mark.parametrize("shape", [(20, 45), (45, 20), (25, 25)])
def test_sparse_form_equals_dense(spark, shape):
    x = counts(*shape)
    m = frame(spark, x)
    norm = normalize.normalize(m.expr, m.cells)
    want = dense_normal(x)
    got = {(r["cell_id"], r["gene_id"]): r["value"] for r in normalize.dense(norm).collect()}
    assert np.allclose([[got[(i, j)] for j in range(shape[1])] for i in range(shape[0])], want)
    side = gram.gram_side(*shape)
    g = (want @ want.T if side == "cell" else want.T @ want) / shape[1]
    pairs, ids, _ = spectrum.eigen(spark, norm, shape[1], 1000)
    rows = pairs.orderBy("comp_idx").collect()
    values = np.array([r["eigenvalue"] for r in rows])
    assert np.allclose(values, np.linalg.eigvalsh(g)) and len(ids) == min(shape)
    by_join = {(r["i"], r["j"]): r["g"] for r in gram.join_gram(norm, side, shape[1]).collect()}
    d = min(shape)
    assert np.allclose([[by_join[(i, j)] for j in range(d)] for i in range(d)], g)
    # vectors over cells are unit and give the projections' variance
    top = spectrum.in_cells(spark, norm, pairs.where(F.col("comp_idx") == d - 1), ids, side, shape[1]).orderBy("cell_id").toPandas()["value"].to_numpy()
    assert abs(top @ top - 1) < 1e-8 and np.allclose(np.abs(top @ want).max(), np.abs(np.linalg.svd(want)[0][:, 0] @ want).max())
    m1, m2 = spectrum.null_moments(norm, shape[1])
    rng = np.random.default_rng(0)
    drawn = [((p := np.array([rng.permutation(r) for r in want])) @ p.T / shape[1]) for _ in range(200)]
    squares = [(y * y).sum() / d for y in drawn]
    assert abs(m1 - values.mean()) < 1e-9 and abs(m2 - np.mean(squares)) < 5 * np.std(squares) / 200**0.5


def test_side_limit_and_constant_gene(spark):
    m = frame(spark, counts(10, 12))
    with pytest.raises(gram.SideTooLarge):
        spectrum.eigen(spark, normalize.normalize(m.expr, m.cells), 12, 5)
    flat = frame(spark, np.ones((5, 3)))
    with pytest.raises(Exception, match="constant"):
        normalize.normalize(flat.expr, flat.cells).genes.collect()


def test_filter_boundaries(spark):
    rows = [("a", "G1", 2.0), ("a", "MT-CO1", 2.0), ("b", "G1", 3.0), ("b", "mt-nd1", 1.0), ("c", "G2", 5.0), ("c", "RPS6", 5.0), ("d", "XMT-1", 4.0)]
    m = CountMatrix.from_long(spark, spark.createDataFrame(rows, "c string, g string, v double"), F.col("c"), F.col("g"), F.col("v"))
    name = dict(map(tuple, m.cells.select("cell_id", "cell").collect()))
    cells = lambda **k: {name[r[0]] for r in qc.passing_cells(m.expr, m.genes, **({"min_genes_per_cell": 1, "mito_percent": 0.0} | k)).collect()}
    assert cells() == {"a", "b", "c", "d"}
    assert cells(min_tp_c=4) == {"c"} and cells(max_tp_c=10) == {"a", "b", "d"}  # strict
    assert cells(min_genes_per_cell=2) == {"a", "b", "c"} and cells(max_genes_per_cell=2) == {"d"}  # inclusive, strict
    assert cells(mito_percent=50.0) == {"b", "c", "d"} and cells(mito_percent=25.0) == {"c", "d"}  # strict, names at their start
    assert cells(ribo_percent=50.0) == {"a", "b", "d"}
    kept = qc.filter_cells_and_genes(m, min_genes_per_cell=99)
    assert kept is m
    assert qc.filter_cells_and_genes(m, min_genes_per_cell=99, on_empty="empty").expr.count() == 0
    with pytest.raises(ValueError):
        qc.filter_cells_and_genes(m, use_raw=True)


def test_wide_table(spark):
    wide = spark.createDataFrame([("x", 1, 0), ("y", 2, 3)], "cell string, A int, B int")
    m = CountMatrix.from_wide(spark, wide)
    got = m.expr.join(m.cells, "cell_id").join(m.genes, "gene_id").select("cell", "gene", "value").collect()
    assert sorted(map(tuple, got)) == [("x", "A", 1.0), ("y", "A", 2.0), ("y", "B", 3.0)]
    with pytest.raises(ValueError):
        CountMatrix.from_wide(spark, wide.select("A", "cell"))


def test_distribution_integrates_density(spark):
    p = rmt.MpParams.of(1.2, 1.2**2 * 1.4)
    grid = np.linspace(p.b_minus, p.b_plus, 4001)[1:-1]
    row = {k: F.lit(getattr(p, k)) for k in ("b_plus", "b_minus", "s", "gamma")}
    out = spark.createDataFrame([(float(x),) for x in grid], "x double").select("x", rmt.mp_pdf(F.col("x"), **row).alias("f"), rmt.mp_cdf(F.col("x"), **row).alias("c")).orderBy("x").toPandas()
    area = np.concatenate([[0], np.cumsum((out["f"].to_numpy()[1:] + out["f"].to_numpy()[:-1]) / 2 * np.diff(grid))])
    assert np.abs(area - out["c"]).max() < 5e-3
    edge = spark.createDataFrame([(p.b_minus - 1,), (p.b_minus,), (p.b_plus + 1,)], "x double").select(rmt.mp_cdf(F.col("x"), **row).alias("c"), rmt.mp_pdf(F.col("x"), **row).alias("f")).collect()
    assert [r["c"] for r in edge] == [0.0, 1.0, 1.0] and all(r["f"] is None for r in edge)


def test_fit_and_cut_by_hand():
    values = np.array([0.5, 0.8, 1.0, 1.2, 1.5, 9.0])
    null = rmt.MpParams.of(1.0, 1.25)
    bulk, p, _ = rmt.mp_fit(values, null)
    assert bulk.max() < 9 and abs(p.moment_1 - bulk.mean()) < 1e-12
    g = (bulk**2).mean() / bulk.mean() ** 2 - 1
    n = len(values) / g  # of the whole spectrum, not of the bulk
    want = bulk.mean() * (1 + math.sqrt(g)) ** 2 + n ** (-2 / 3) * g ** (5 / 6) * (1 + math.sqrt(g)) ** (4 / 3)
    assert abs(rmt.tracy_widom(bulk, len(values)) - want) < 1e-12
    with pytest.raises(ValueError):
        rmt.tracy_widom(np.array([]), 6)


def test_step_policy_and_threshold():
    p = sparsity.StepPolicy(0.01, 0.9)
    seen = []
    for corr in (0.9, 0.1, 0.9, 0.1, 0.1):
        seen.append(round(p.sparsity, 3))
        found = p.tell(corr, 0.5)
    assert seen == [0.999, 0.989, 0.949, 0.939, 0.899] and abs(found - 0.939) < 1e-12
    rng = np.random.default_rng(0)
    sample = np.abs(rng.normal(0, math.sqrt(1 / 200), (4000, 200))).max(axis=1).mean()
    assert abs(sparsity.random_vector_threshold(200) - sample) < 2e-3


def test_random_rows_do_not_depend_on_dealing(spark):
    m = frame(spark, counts(12, 30))
    a, b = (perturb.random_sparse(m.cells.repartition(k), list(range(30)), {0: 0.2, 1: 0.2}, 3).collect() for k in (1, 5))
    assert sorted(a) == sorted(b) and 60 < len(a) < 240
    one = CountMatrix.from_ids(spark.createDataFrame([(i, j, 1.0) for i in range(12) for j in range(5)], "cell_id long, gene_id long, value double"))
    flips = perturb.flipped_zeros(one.expr, one.cells, list(range(30)), {0: 1.0}, 3)
    assert flips.count() == 360 and flips.select("cell_id", "gene_id").distinct().count() == 360


def test_trimmed_median(spark):
    scores = [0.9, 0.91, 0.92, 0.93, 0.1]
    df = spark.createDataFrame([(0, i + 1, 0, s) for i, s in enumerate(scores)], "rep_a int, rep_b int, comp_idx int, score double")
    r = robust.robust_components(df, 0.5).first()
    assert abs(r["rob_score"] - 0.915) < 1e-12 and r["is_robust"]


def test_planted_rank_is_found_and_embedded(spark):
    m = frame(spark, counts(120, 60, seed=3, rank=2))
    result = significance.find_optimal_pc(spark, m, Config(sparsity=0.97, n_rand_matrix=4))
    k = result.n_signals  # the planted two, and at most little that row scaling bends out of their plane
    assert 2 <= k <= 3 and 2 <= result.optimal_pc_count <= k
    scores = result.scores.toPandas()["score"]
    assert len(scores) == 6 * k and scores.between(0, 1 + 1e-9).all()
    pcs = np.array(significance.pca(result).orderBy("cell_id").toPandas()["pcs"].tolist())
    kept = [r["comp_idx"] for r in result.robust.where("is_robust").orderBy("comp_idx").collect()]
    values = np.array([r["eigenvalue"] for r in result.values.orderBy("comp_idx").collect()][-k:])[kept]
    assert np.allclose((pcs**2).sum(axis=0), values)  # unit vectors times the root of their eigenvalue
    assert significance.robust_score_report(result).count() == k
    hist, curve = significance.spectrum_report(spark, result)
    assert hist.agg(F.sum("n")).first()[0] == 60 and curve.count() == 2000


def test_noise_has_no_components(spark):
    result = significance.find_optimal_pc(spark, frame(spark, counts(60, 80, seed=4)), Config(sparsity=0.97, n_rand_matrix=3))
    assert result.optimal_pc_count == 0
    if result.n_signals == 0:
        with pytest.raises(RuntimeError):
            significance.pca(result)


def test_config_is_checked(spark):
    for bad in ({"n_rand_matrix": 1}, {"sparsity": 1.5}, {"sparsity_step": 0.0}):
        with pytest.raises(ValueError):
            Config(**bad)
    tiny = frame(spark, counts(3, 6))
    with pytest.raises(SparsityNotFound):
        sparsity.find_sparsity(spark, tiny.expr, tiny.cells, list(range(6)))


def test_entry_point_lists_queries_with_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 33
