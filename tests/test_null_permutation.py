import math

from eigenforge.functions.rng import permute_rows
from eigenforge.operators import normalize
from eigenforge.plans import queries


def _norm(spark, n_cells=20, n_genes=9):
    """Some empty rows, a position that comes twice, a cell without an id and one that is listed twice."""
    rows = [(c * 3, g * 5, float(1 + (c * 7 + g * 3) % 4)) for c in range(n_cells) for g in range(n_genes) if (c + g * g) % 4 and c % 9]
    expr = spark.createDataFrame([*rows, (*rows[4][:2], 2.0), (None, 5, 1.0), (3, None, 1.0)], "cell_id long, gene_id long, value double")
    cells = spark.createDataFrame([(c * 3,) for c in range(n_cells)] + [(None,), (6,)], "cell_id long")
    return normalize.normalize(expr, cells)


def _by_join(norm):
    """The definition: all positions, each with its entries."""
    total = {r["rep"]: r["c"] for r in norm.total.collect()}
    a = {}
    for r in norm.a.collect():
        a.setdefault((r["cell_id"], r["gene_id"]), []).append(r["a"])
    genes = norm.genes.collect()
    found = [(c["cell_id"], g["gene_id"], total[c["rep"]] / c["l2"] * (x - g["v"]) - g["m"]) for c in norm.cells.collect() for g in genes for x in a.get((c["cell_id"], g["gene_id"]), [0.0])]
    return sorted(found, key=str)


def _near(got, want):
    return len(got) == len(want) and all(x[:2] == y[:2] and math.isclose(x[2], y[2], abs_tol=1e-12) for x, y in zip(got, want))


def _above_caches(df):
    """Lines of the plan, without the plans of cached tables."""
    lines, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if below is None or depth <= below:
            below = depth if "InMemoryTableScan" in line else None
            lines.append(line.lstrip(" :+-*"))
    return lines


def test_dense_keeps_odd_rows(spark, monkeypatch):
    norm = _norm(spark)
    want = _by_join(norm)
    for positions in (normalize.POSITIONS, 7):
        monkeypatch.setattr(normalize, "POSITIONS", positions)
        got = sorted(normalize.dense(norm).select("cell_id", "gene_id", "value").collect(), key=str)
        assert _near(got, want)


def test_dense_bounds_a_tasks_share(spark, monkeypatch):
    norm = _norm(spark)
    monkeypatch.setattr(normalize, "POSITIONS", 11)
    assert normalize.dense(norm).rdd.getNumPartitions() == 18  # 22 cells of 9 genes, 11 positions a task
    monkeypatch.setattr(normalize, "UNSORTED", 5)
    assert normalize.dense(norm).rdd.getNumPartitions() == 5


def test_genes_numbered_once_give_the_same_rows(spark):
    rows = [(c * 3, g * 5, float(1 + (c * 7 + g * 3) % 4)) for c in range(20) for g in range(9) if (c + g * g) % 4 and c % 9]
    expr = spark.createDataFrame([*rows, (None, 5, 1.0), (3, None, 1.0)], "cell_id long, gene_id long, value double")
    cells = spark.createDataFrame([(c * 3,) for c in range(20)] + [(None,)], "cell_id long")
    norm = normalize.normalize(expr, cells)
    dense = normalize.dense(norm)
    want = sorted(permute_rows(dense.select("cell_id", "gene_id", "value"), 7).collect())
    assert len(want) == 20 * 9  # a row without an id goes
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (was, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = permute_rows(normalize.dense(norm), 7, norm.genes).select("cell_id", "gene_id", "value")
            assert sorted(got.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_positions_are_shuffled_once(spark):
    """The grid was shuffled six times: for its entries, by cell and by place, once for genes and once for values."""
    lines = _above_caches(queries.null_permutation(spark, "/root/testdata/sf0.001"))
    assert sum("REPARTITION_BY_NUM" in x for x in lines) == 1
    assert sum("row_number" in x and "Window" in x for x in lines) == 2  # values of a row; genes, once for all rows
    assert not [x for x in lines if x.startswith("Exchange hashpartitioning(cell_id") and "place" in x]
