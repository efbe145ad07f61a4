from eigenforge.plans import queries

SF = "/root/testdata/sf0.001"


def test_every_order_is_ingested(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderpriority").collect()
    got = queries.wide_ingest(spark, SF).collect()
    assert {r["gene"] for r in got} == {r["o_orderpriority"] for r in orders}
    assert {r["cell"] for r in got} == {str(r["o_custkey"]) for r in orders}
    assert sum(r["value"] for r in got) == len(orders)
