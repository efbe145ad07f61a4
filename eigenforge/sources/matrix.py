"""Count matrices as DataFrames: expr(cell_id, gene_id, value), cells(cell_id, cell), genes(gene_id, gene)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eigenforge.session import materialize, shuffle_partitions

#: Columns of a wide table that are melted at once.
MELT = 1024


def dense_ids(spark: SparkSession, labels: DataFrame, label: str, name: str) -> DataFrame:
    """0-based ids in label order. Ranges of labels are numbered apart; the driver sees one count for each range."""
    ranged = labels.select(label).distinct().repartitionByRange(shuffle_partitions(spark), label).select(label, F.spark_partition_id().alias("part"))
    ranged, _ = materialize(spark, ranged, "ranged-labels")
    before, total = [], 0
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, before long")
    order = Window.partitionBy("part").orderBy(label)
    return ranged.join(F.broadcast(offsets), "part").select((F.col("before") + F.row_number().over(order) - 1).alias(name), label)


@dataclass(frozen=True)
class CountMatrix:
    expr: DataFrame
    cells: DataFrame
    genes: DataFrame
    raw: DataFrame | None = None  # counts to take statistics from, if kept apart

    @staticmethod
    def from_ids(expr: DataFrame, raw: DataFrame | None = None) -> CountMatrix:
        """A matrix whose ids are given; labels are the ids as text. Zero and null values are no entries."""
        e = expr.select(F.col("cell_id").cast("long"), F.col("gene_id").cast("long"), F.col("value").cast("double").alias("value")).where("value != 0")
        cells = expr.select(F.col("cell_id").cast("long")).distinct().withColumn("cell", F.col("cell_id").cast("string"))
        genes = expr.select(F.col("gene_id").cast("long")).distinct().withColumn("gene", F.col("gene_id").cast("string"))
        return CountMatrix(e, cells, genes, raw)

    @staticmethod
    def from_long(spark: SparkSession, df: DataFrame, cell: Column, gene: Column, value: Column) -> CountMatrix:
        """A matrix from rows of (cell, gene, value); values of one position are added up."""
        rows = df.select(cell.cast("string").alias("cell"), gene.cast("string").alias("gene"), value.cast("double").alias("value")).groupBy("cell", "gene").agg(F.sum("value").alias("value"))
        rows, _ = materialize(spark, rows, "long")
        cells, genes = dense_ids(spark, rows, "cell", "cell_id"), dense_ids(spark, rows, "gene", "gene_id")
        expr = rows.join(cells, "cell").join(genes, "gene").where("value != 0").select("cell_id", "gene_id", "value")
        return CountMatrix(expr, cells, genes)

    @staticmethod
    def from_wide(spark: SparkSession, df: DataFrame) -> CountMatrix:
        """A matrix from a table whose first column is `cell` and whose other columns are one gene each.

        Rows are melted batch by batch through Arrow, and zeros and nulls are left out there, so neither the plan nor what
        is shuffled grows with columns x rows. Gene ids follow the order of the column names. Rows of one cell are added up.
        """
        if df.columns[0] != "cell":
            raise ValueError("the first column of a wide table must be named cell")
        names = sorted(df.columns[1:])
        if len(set(names)) < len(names):
            raise ValueError("genes of a wide table must have different names")
        number = {name: i for i, name in enumerate(names)}
        ids = [number[c] for c in df.columns[1:]]

        def melt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column(0)
                cells = row.field(0).cast(pa.string())
                for first in range(0, len(ids), MELT):
                    rows, genes, values = [], [], []
                    for j in range(first, min(len(ids), first + MELT)):
                        x = row.field(j + 1).cast(pa.float64(), safe=False).fill_null(0.0).to_numpy(zero_copy_only=False)
                        at = np.flatnonzero(x)
                        rows.append(at)
                        genes.append(np.full(len(at), ids[j], dtype=np.int64))
                        values.append(x[at])
                    at = pa.array(np.concatenate(rows))
                    yield pa.record_batch([cells.take(at), pa.array(np.concatenate(genes)), pa.array(np.concatenate(values))], names=["cell", "gene_id", "value"])

        # one column that holds the row: a function's arguments are looked up by name, one by one
        long = df.select(F.struct("*").alias("row")).mapInArrow(melt, "cell string, gene_id long, value double").groupBy("cell", "gene_id").agg(F.sum("value").alias("value"))
        long, _ = materialize(spark, long.where("value != 0"), "melted")
        cells = dense_ids(spark, df.select(F.col("cell").cast("string").alias("cell")), "cell", "cell_id")
        genes = spark.createDataFrame(list(enumerate(names)), "gene_id long, gene string")
        return CountMatrix(long.join(cells, "cell").select("cell_id", "gene_id", "value"), cells, genes)

    def write(self, path: str) -> None:
        for name in ("expr", "cells", "genes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> CountMatrix:
        return CountMatrix(*(spark.read.parquet(f"{path}/{name}") for name in ("expr", "cells", "genes")))
