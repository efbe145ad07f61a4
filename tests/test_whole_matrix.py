"""The whole normalised matrix is made block by block."""

import numpy as np

from eigenforge.operators import blocks, normalize
from eigenforge.sources.matrix import CountMatrix


def test_positions_come_from_blocks_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SPELLED", 10)  # several batches a block, and a row in more than one
    rng = np.random.default_rng(3)
    x = rng.poisson(0.8, (37, 13)) * rng.integers(1, 4, (37, 13))
    x[5] = 0  # a cell without counts
    rows = [(int(i), int(j) * 7 + 2, float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    m = CountMatrix.from_ids(spark.createDataFrame(rows, "cell_id long, gene_id long, value double"))
    cells = spark.range(37).withColumnRenamed("id", "cell_id")
    normal = blocks.normalize_blocks(spark, blocks.build(spark, m.expr, cells, [j * 7 + 2 for j in range(13)], block_rows=9))
    out = blocks.dense(spark, normal)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {(r["cell_id"], r["gene_id"]): r["value"] for r in out.collect()}
    want = {(r["cell_id"], r["gene_id"]): r["value"] for r in normalize.dense(normalize.normalize(m.expr, cells)).collect()}
    assert len(got) == 37 * 13 and got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()))


def test_gram_product_hands_over_arrays_not_rows(spark, monkeypatch):
    import pyarrow as pa

    from eigenforge.plans import queries

    given, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (given.append(type(data)), create(self, data, *a, **k))[1])
    assert queries.gram_product(spark, "/root/testdata/sf0.001").count() == 200
    assert given == [pa.Table]
