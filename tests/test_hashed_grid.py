"""Hashed draws in packs against the hash of each position in SQL."""

from pyspark.sql import functions as F

from eigenforge.functions.rng import uniform
from eigenforge.operators import perturb

IDS = [0, 7, -3, 10, 99, 100, 12345, 999_999, 2**40, -(2**62), None]


def _ids(spark, name):
    return spark.createDataFrame([(i,) for i in IDS], f"{name} long")


def _keys(df):
    return sorted((r["cell_id"] is None, r["cell_id"] or 0, r["gene_id"] is None, r["gene_id"] or 0, r["value"]) for r in df.collect())


def test_draws_in_packs_are_those_of_single_positions(spark, monkeypatch):
    monkeypatch.setattr(perturb, "GENES_A_PACK", 4)
    cells, genes = _ids(spark, "cell_id"), _ids(spark, "gene_id")
    every = cells.crossJoin(genes).withColumn("u", uniform(7, "flip", F.col("cell_id"), F.col("gene_id"))).withColumn("value", F.lit(1.0))
    taken = every.where("pmod(cell_id, 2) = 0 or gene_id = 7 or gene_id is null").select("cell_id", "gene_id", F.lit(2.0).alias("value"))
    drawn = every.where("u < 0.4").drop("u")
    assert _keys(perturb.bernoulli_grid(cells, genes, 0.4, 7, "flip")) == _keys(drawn)
    assert _keys(perturb.hashed_flips(taken, cells, genes, 0.4, 7)) == _keys(drawn.join(taken, ["cell_id", "gene_id"], "left_anti"))
    assert _keys(perturb.with_grid(taken, cells, genes, 0.4, 7, "flip")) == _keys(perturb.added(taken, drawn))
    assert perturb.bernoulli_grid(cells, genes, 1.0, 7).count() == len(IDS) ** 2 and perturb.bernoulli_grid(cells, genes, 0.0, 7).count() == 0


def test_no_position_is_shuffled(spark):
    ids = spark.range(40)
    plan = perturb.bernoulli_grid(ids.toDF("cell_id"), ids.toDF("gene_id"), 0.5, 7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Nested" not in plan


def test_texts_of_all_lengths_are_hashed_in_one_pass(monkeypatch):
    import hashlib

    import numpy as np

    from eigenforge.functions import md5

    calls, block = [], md5._block
    monkeypatch.setattr(md5, "_block", lambda *a: (calls.append(1), block(*a))[1])
    ids = np.array([-(2**63), -77, 0, 5, 42, 999, 1000, 123_456, 10**18])
    texts = perturb._texts(ids)
    for beginning in (b"", b"7|grid|", b"7|grid|12345|", b"x" * 34):
        hashes = [int(hashlib.md5(beginning + str(i).encode()).hexdigest()[:8], 16) for i in ids.tolist()]
        assert md5.first_bits(beginning, texts).tolist() == hashes
        assert perturb.drawn(beginning, texts, 2**31).tolist() == [k for k, h in enumerate(hashes) if h < 2**31]
    assert len(calls) == 8  # one for all ids, not one for each length
