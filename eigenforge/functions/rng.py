"""Counter-based random columns: values depend on keys alone, so results are the same however rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, *keys: Column) -> Column:
    """In [0, 1): the first eight hex digits of an MD5 over seed, tag and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: A prime below 2^31: squares of what is below it fit into 64 bits.
PRIME = 2147483647


def mixed(seed: int, cell: Column, gene: Column) -> Column:
    """Whole numbers in [0, PRIME) by position, from products and squares that SQL of any engine repeats."""
    p = F.lit(PRIME).cast("long")
    h = F.pmod(F.pmod(cell, p) * 48271 + F.pmod(gene, p) * 69621 + F.lit(seed), p)
    for k in (12345, 67891):
        h = F.pmod(h * h + k, p)
    return h


def grid(cells: DataFrame, genes: DataFrame) -> DataFrame:
    """All positions of a matrix; for queries that densify on purpose. Genes are the side of a checked, small size."""
    return cells.select("cell_id").crossJoin(genes.select("gene_id"))


def permute_rows(dense: DataFrame, seed: int, genes: DataFrame | None = None) -> DataFrame:
    """Each row's values dealt anew over its own genes: two orders of the row, one by gene, one at random, joined by place.

    genes (rep, gene_id): those of matrices with a repeat that have every position once. Genes then have the same places in each
    row and are numbered once, so positions need no shuffle by place as long as Spark finds the genes small.
    """
    order = [mixed(seed, F.col("cell_id"), F.col("gene_id")), "gene_id"]
    if genes is not None:
        place = F.row_number().over(Window.partitionBy("rep").orderBy("gene_id"))
        dealt = F.row_number().over(Window.partitionBy("cell_id", "rep").orderBy(*order))
        values = dense.where("cell_id IS NOT NULL").select("rep", "cell_id", "value", dealt.alias("place"))
        return values.join(genes.select("rep", "gene_id", place.alias("place")), ["rep", "place"]).select("rep", "cell_id", "gene_id", "value")
    by_gene = Window.partitionBy("cell_id").orderBy("gene_id")
    at_random = Window.partitionBy("cell_id").orderBy(*order)
    places = dense.select("cell_id", "gene_id", F.row_number().over(by_gene).alias("place"))
    values = dense.select("cell_id", "value", F.row_number().over(at_random).alias("place"))
    return places.join(values, ["cell_id", "place"]).select("cell_id", "gene_id", "value")
