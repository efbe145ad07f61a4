"""The five-step normalisation, as statistics of the sparse counts.

With S = log1p(x / row sum), column mean mu and population deviation sd, A = S / sd stays sparse and v = mu / sd is one
number a column. Standardised rows are A - v; l2 is their length, c the mean length, and m the column means of what the
scaling leaves. So the dense matrix X = c / l2 * (A - v) - m never has to exist. Every table has a `rep` column: several
matrices over the same cells and genes go through one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenforge.session import shuffle_partitions

#: Positions of dense matrices (about) that a task sorts.
POSITIONS = 1 << 16
#: Partitions that Spark's writer fills without holding or sorting rows (spark.shuffle.sort.bypassMergeThreshold).
UNSORTED = 200


@dataclass(frozen=True)
class Normalized:
    a: DataFrame  # rep, cell_id, gene_id, a
    genes: DataFrame  # rep, gene_id, mu, sd, v, m
    cells: DataFrame  # rep, cell_id, l2
    total: DataFrame  # rep, c, r1, r2, vv, mm, vm
    n: int  # cells
    _kept: DataFrame  # what a is read from

    def release(self) -> None:
        """Frees what was cached, once nothing reads it any more."""
        for df in (self._kept, self.genes, self.cells):
            df.unpersist()


def with_rep(expr: DataFrame) -> DataFrame:
    return expr if "rep" in expr.columns else expr.withColumn("rep", F.lit(0))


def l1_log(expr: DataFrame) -> DataFrame:
    """s = ln(1 + x / sum of the row's absolute values); a row of zeros has no entries."""
    expr = with_rep(expr)
    rows = expr.groupBy("rep", "cell_id").agg(F.sum(F.abs("value")).alias("l1"))
    rows = rows.hint("shuffle_hash")  # a row a cell: entries needn't be sorted to meet it, and those of a large cell can be split
    return expr.join(rows, ["rep", "cell_id"]).select("rep", "cell_id", "gene_id", F.log1p(F.try_divide("value", "l1")).alias("s"))


def gene_moments(s: DataFrame, n: int) -> DataFrame:
    """Column mean and population deviation; positions without an entry are zeros and count."""
    sums = s.groupBy("rep", "gene_id").agg(F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    mu = F.col("s1") / F.lit(float(n))
    return sums.select("rep", "gene_id", mu.alias("mu"), F.sqrt(F.greatest(F.col("s2") / F.lit(float(n)) - mu * mu, F.lit(0.0))).alias("sd"))


def _checked(sd: Column) -> Column:
    """A constant column cannot be standardised; the run fails rather than spread NaN."""
    return F.when(sd * sd > 1e-18, sd).otherwise(F.raise_error(F.lit("a gene is constant after L1 scaling and log: filter it out first")).cast("double"))


def normalize(expr: DataFrame, cells: DataFrame) -> Normalized:
    """Normalise counts over the given cells and the genes that occur; a cell without counts is a row of zeros."""
    n = cells.count()
    s = l1_log(expr)
    moments = gene_moments(s, n).select("rep", "gene_id", "mu", _checked(F.col("sd")).alias("sd")).withColumn("v", F.col("mu") / F.col("sd"))
    a = s.join(moments, ["rep", "gene_id"]).select("rep", "cell_id", "gene_id", (F.col("s") / F.col("sd")).alias("a"), "v").cache()
    vv = moments.groupBy("rep").agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    sums = a.groupBy("rep", "cell_id").agg(F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("a") * F.col("v")).alias("av"))
    every = F.broadcast(vv).join(cells.select("cell_id"), how="cross").join(sums, ["rep", "cell_id"], "left")  # vv: a row for each repeat
    length = F.sqrt(F.coalesce("aa", F.lit(0.0)) - 2 * F.coalesce("av", F.lit(0.0)) + F.col("vv"))
    lengths = every.select("rep", "cell_id", length.alias("l2")).cache()
    scale = lengths.groupBy("rep").agg(F.avg("l2").alias("c"), F.sum(1 / F.col("l2")).alias("r1"), F.sum(1 / (F.col("l2") * F.col("l2"))).alias("r2"))
    inner = a.join(lengths, ["rep", "cell_id"]).groupBy("rep", "gene_id").agg(F.sum(F.col("a") / F.col("l2")).alias("ar"))
    m = F.col("c") / F.lit(float(n)) * (F.col("ar") - F.col("r1") * F.col("v"))
    genes = moments.join(inner, ["rep", "gene_id"]).join(F.broadcast(scale), "rep").select("rep", "gene_id", "mu", "sd", "v", m.alias("m")).cache()
    mm = genes.groupBy("rep").agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("v") * F.col("m")).alias("vm"))
    return Normalized(a.drop("v"), genes, lengths, scale.join(vv, "rep").join(mm, "rep"), n, a)


def dense(norm: Normalized) -> DataFrame:
    """Every position of the normalised matrices: rep, cell_id, gene_id, value. For checks and small matrices.

    Entries get their values while they are few. Positions go to their rows once, by cell and repeat, with the value of an empty
    one; there an entry's value takes the place of its position's. The number of tasks follows that of positions.
    """
    genes = norm.genes.select("rep", "gene_id", "v", "m")
    empty = norm.cells.join(genes, "rep").select("rep", "cell_id", "gene_id", "l2", (F.lit(0.0) - F.col("v")).alias("z"), "m", F.lit(None).cast("long").alias("entry"))
    entries = norm.a.join(genes, ["rep", "gene_id"]).join(norm.cells, ["rep", "cell_id"])
    entries = entries.select("rep", "cell_id", "gene_id", "l2", (F.coalesce("a", F.lit(0.0)) - F.col("v")).alias("z"), "m", F.col("gene_id").alias("entry"))
    value = F.col("c") / F.col("l2") * F.col("z") - F.col("m")
    mean = norm.cells.groupBy("rep").agg(F.avg("l2").alias("c"))  # as in norm.total, without its other sums
    places = empty.unionByName(entries).join(F.broadcast(mean), "rep").select("rep", "cell_id", "gene_id", value.alias("value"), "entry")
    parts = min(-(-norm.n * norm.genes.count() // POSITIONS), max(UNSORTED, shuffle_partitions(norm.genes.sparkSession)))
    row = Window.partitionBy("cell_id", "rep").orderBy("gene_id", F.desc("entry")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = places.repartition(max(1, parts), "cell_id", "rep").withColumn("taken", F.last("entry", ignorenulls=True).over(row))
    return merged.where(F.col("entry").isNotNull() | ~F.col("taken").eqNullSafe(F.col("gene_id"))).select("rep", "cell_id", "gene_id", "value")
