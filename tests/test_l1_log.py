import math

from pyspark.sql import functions as F

from eigenforge.operators import normalize


def test_entries_are_not_sorted_to_meet_their_sums(spark):
    """Above the threshold of a broadcast both sides were sorted, so cost grew faster than the entries."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (was, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            expr = spark.range(4000).select((F.col("id") % 37).alias("cell_id"), F.col("id").alias("gene_id"), (F.col("id") % 5 + 1).cast("double").alias("value"))
            s = normalize.l1_log(expr)
            assert s.count() == 4000
            plan = s._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and " Sort [" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_l1_log_keeps_odd_rows(spark):
    rows = [(1, 1, 2.0), (1, 2, -6.0), (1, 2, -6.0), (2, 1, 0.0), (3, None, 4.0), (4, 1, None), (4, 2, 3.0), (5, 5, None), (None, 1, 7.0)]
    rows += [(6, g, 1.0) for g in range(500)]  # most entries in one cell
    got = normalize.l1_log(spark.createDataFrame(rows, "cell_id long, gene_id long, value double")).collect()
    assert {r["rep"] for r in got} == {0}
    l1 = {c: sum(abs(v) for k, _, v in rows if k == c and v is not None) for c, _, _ in rows}
    want = [(c, g, math.log1p(v / l1[c]) if v is not None and l1[c] else None) for c, g, v in rows if c is not None]
    assert sorted(((r["cell_id"], r["gene_id"], r["s"]) for r in got), key=str) == sorted(want, key=str)


def test_repeats_have_their_own_sums(spark):
    expr = spark.createDataFrame([(0, 1, 1, 1.0), (0, 1, 2, 3.0), (1, 1, 1, 1.0)], "rep int, cell_id long, gene_id long, value double")
    got = {(r["rep"], r["gene_id"]): r["s"] for r in normalize.l1_log(expr).collect()}
    assert all(math.isclose(got[k], math.log1p(x)) for k, x in {(0, 1): 0.25, (0, 2): 0.75, (1, 1): 1.0}.items()) and len(got) == 3
