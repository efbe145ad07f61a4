"""Running sums over a whole table in order, without a window that puts the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eigenforge.session import materialize, shuffle_partitions


def running(spark: SparkSession, df: DataFrame, by: str, weight: Column | None = None, name: str = "upto") -> DataFrame:
    """df with the sum of weight (1 by default) over the rows up to each row in order of `by`.

    Ranges of values are summed apart; the driver sees one sum for each range. Equal values are in one range, in any order.
    """
    dealt = df.withColumn("_w", (weight if weight is not None else F.lit(1.0)).cast("double"))
    ranged = dealt.repartitionByRange(shuffle_partitions(spark), by).withColumn("_part", F.spark_partition_id())
    ranged, _ = materialize(spark, ranged, "ordered")
    before, total = [], 0.0
    for part, w in sorted(ranged.groupBy("_part").agg(F.sum("_w")).collect()):
        before.append((part, total))
        total += w
    offsets = spark.createDataFrame(before, "_part int, _before double")
    rows = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.sum("_w").over(rows))
    return summed.drop("_part", "_before", "_w")
