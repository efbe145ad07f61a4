import numpy as np
from test_matrix_operators import counts, frame

from eigenforge.config import Config
from eigenforge.operators import sparsity
from eigenforge.operators.small import fits
from eigenforge.plans import significance


def sparse(n, m):
    x = counts(n, m, seed=3, rank=2)
    return x * (np.random.default_rng(1).random((n, m)) < 0.4) + np.eye(n, m) + np.eye(n, m, n - m if n < m else 0)


def test_whole_repeats_equal_the_distributed_plan(spark):
    for shape in ((60, 40),):
        m = frame(spark, sparse(*shape))
        ids = [r[0] for r in m.genes.orderBy("gene_id").select("gene_id").collect()]
        small, large = Config(sparsity_step=0.02, sparsity_threshold=0.5, n_rand_matrix=3), Config(sparsity_step=0.02, sparsity_threshold=0.5, n_rand_matrix=3, task_bytes=0)
        assert fits(*shape, small.task_bytes) and not fits(*shape, 0)
        a, b = (sparsity.find_sparsity(spark, m.expr, m.cells, ids, c) for c in (small, large))
        assert a[0] == b[0] and np.allclose(a[1]["corr"], b[1]["corr"])
        x, y = (significance.find_optimal_pc(spark, m, c) for c in (small, large))
        assert x.n_signals == y.n_signals > 0 and x.optimal_pc_count == y.optimal_pc_count
        key = ["rep_a", "rep_b", "comp_idx"]
        assert np.allclose(x.scores.orderBy(key).toPandas()["score"], y.scores.orderBy(key).toPandas()["score"])


def test_reports_and_clean_up(spark):
    m = frame(spark, counts(40, 60, seed=3, rank=2))
    r = significance.find_optimal_pc(spark, m, Config(sparsity=0.9, n_rand_matrix=2))
    values = np.array([x[0] for x in r.values.orderBy("comp_idx").select("eigenvalue").collect()])
    shares = significance.variance_report(r).orderBy("comp_idx").toPandas()
    assert np.allclose(shares["variance"], values**2 / 40) and abs(shares["share"].sum() - 1) < 1e-12
    row = significance.fit_report(spark, r).first()
    assert (row["n_cells"], row["n_genes"], row["n_noise"]) == (40, 60, 40 - r.n_signals) and abs(row["sigma2"] - r.bulk.mean()) < 1e-12 and 0 < row["ks"] < 1
    noise = r.noise.toPandas()["eigenvalue"]
    assert len(noise) and noise.max() < r.lambda_c and len(noise) + r.n_signals <= len(values)
    assert {x[0] for x in significance.signal_components(r, 1).select("comp_idx").distinct().collect()} == {r.n_signals - 1}
    assert significance.signal_components(r).select("comp_idx").distinct().count() == r.n_signals
    curve = significance.spectrum_report(spark, r, 20)[1].toPandas()
    assert len(curve) == 2000 and abs(curve["x"].max() - round(r.bulk.max() + 0.5)) < 1e-9
    significance.clean_up(spark, r)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in r.paths:
        path = fs(p)
        assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_entry_without_the_corpus_operators(monkeypatch):
    """A library that they need is missing: the other queries stay."""
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("eigenforge.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr("importlib.import_module", lambda name: (_ for _ in ()).throw(ImportError(name)))
    assert "gene_stats" in __spark_entry__.queries() and not any(n.startswith("op") and n[2:3].isdigit() for n in __spark_entry__.queries())
    assert "gene_stats" in __spark_entry__.oracle_sql()


def test_second_least_match_in_panels(spark):
    rng = np.random.default_rng(5)
    base, probes = np.linalg.qr(rng.normal(size=(23, 23)))[0], {r: rng.normal(size=(11, 23)) for r in (2, 7)}
    rows = [(r, 12 + i, v.tolist()) for r, x in probes.items() for i, v in enumerate(x)]
    got = sparsity.second_least_match(
        spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "comp_idx int, vec array<double>"), spark.createDataFrame(rows, "rep int, comp_idx int, vec array<double>"), 23, width=4
    ).collect()
    want = {r: np.sort(np.abs(x @ base.T).max(axis=1))[1] for r, x in probes.items()}
    assert len(got) == 2 and all(abs(r["corr"] - want[r["rep"]]) < 1e-12 for r in got)
