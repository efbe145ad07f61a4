"""Connected components of an edge table, without gathering a vertex's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.session import drop_path, materialize


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for each end of an edge (src, dst); component is the smallest id that edges lead to.

    Each round takes the least label among a vertex's own and its neighbours', then the label of that label, so paths
    halve. Sums per vertex are partial; a hub costs one row a task. Joins by a hub or by a giant component's label read
    tables on both sides and nothing else in their stage, so Spark's skew join splits them. Rounds are cut by tables in
    the shared folder.
    """
    both, edges_path = materialize(spark, edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct(), "edges")
    labels, path = materialize(spark, both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["dst"] == labels["id"]).select(F.col("src").alias("id"), "label", F.lit(None).cast("long").alias("own"))
        own = labels.select("id", "label", F.col("label").alias("own"))
        least = seen.unionByName(own).groupBy("id").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        least, least_path = materialize(spark, least, "least")
        up = least.select(F.col("id").alias("label"), F.col("label").alias("higher"))
        new, new_path = materialize(spark, least.join(up, "label").select("id", F.col("higher").alias("label"), "own"), "labels")
        moved = new.where("label != own").limit(1).count()
        for p in (path, least_path):
            drop_path(spark, p)
        labels, path = new.select("id", "label"), new_path
        if not moved:
            drop_path(spark, edges_path)
            return labels.select("id", F.col("label").alias("component"))
