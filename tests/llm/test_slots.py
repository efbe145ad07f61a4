"""The prefilter's table has few rows whatever the set, and lets each of its keys through."""

from pyspark.sql import functions as F

from eigenforge.llm.slots import may_hold, slots_of


def test_each_key_passes_and_few_others_do(spark):
    keys = spark.range(300_000).select(F.xxhash64("id").alias("key"))
    slots = slots_of(keys, "key")
    assert slots.count() <= 1 << 16
    asked = spark.range(400_000).select("id", F.xxhash64("id").alias("key"))
    got = may_hold(asked, "key", slots, "maybe").groupBy((F.col("id") < 300_000).alias("own"), "maybe").count().collect()
    found = {(r["own"], r["maybe"]): r["count"] for r in got}
    assert found[(True, True)] == 300_000 and (True, False) not in found and found[(False, True)] < 2_000
