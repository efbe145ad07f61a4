"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products (operator 6).

Equal vectors are one node with a count, so copies cost nothing. Centroids are learned on a bounded sample; every node
goes to the cell of its nearest centroid and, as a visitor, to the next nearest ones. Within a label and cell, blocks
of bounded size are multiplied; a cell of any size is cut into pairs of blocks that are tasks of their own. A block
pair returns counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.llm.components import connected_components
from eigenforge.session import materialize, ship_package

#: Parameters of the search: nodes a cell should have, centroids at most, sample for training them at most (vectors,
#: and numbers in all), cells a node goes to, nodes in a block.
CELL, MAX_CELLS, SAMPLE, SAMPLE_NUMBERS, PROBES, BLOCK = 1024, 4096, 65_536, 8_000_000, 4, 1024
ITERATIONS = 8


def unit(vectors: list) -> np.ndarray:
    """Rows scaled to length 1 in double precision; dividing by the largest entry first keeps squares finite."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; an empty cell takes the row that fits its own centroid worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ITERATIONS if k > 1 else 1):
        best, own = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for at in range(0, len(x), 4096):
            p = x[at : at + 4096] @ c.T
            best[at : at + 4096] = p.argmax(axis=1)
            own[at : at + 4096] = p.max(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, best, x)
        length = np.sqrt((new * new).sum(axis=1))
        for empty, worst in zip(np.flatnonzero(length < 1e-12), own.argsort()):
            new[empty], length[empty] = x[worst], 1.0
        c = new / length[:, None]
    return c


def _usable(embedding) -> F.Column:
    d = F.transform(embedding, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(d, finite) & F.exists(d, lambda x: x != 0), F.lit(False))


def _assign(nodes: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Each node once for every cell it goes to; cells: its own first. Vectors of other lengths share a cell by length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = min(probes, len(centroids))
        for pdf in batches:
            cells: list[list[int]] = [[-len(v)] for v in pdf["embedding"]]
            fits = [i for i, v in enumerate(pdf["embedding"]) if len(v) == centroids.shape[1]]
            if fits:
                p = unit([pdf["embedding"].iloc[i] for i in fits]) @ centroids.T
                top = np.argsort(-p, axis=1, kind="stable")[:, :t]
                for i, row in zip(fits, top.tolist()):
                    cells[i] = row
            yield pdf.assign(cells=cells)

    out = nodes.mapInPandas(run, "label string, node long, copies long, embedding array<double>, cells array<int>")
    return out.select("*", F.explode("cells").alias("cell"))


def _compare(limit: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, lo, hi = int(pdf["cell"].iloc[0]), int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        x, n = unit(pdf["embedding"].tolist()), len(pdf)
        block, home = pdf["block"].to_numpy(), np.array([c[0] for c in pdf["cells"]])
        node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        at_home = home == cell
        cells = np.array([list(c) + [c[0]] * (max(map(len, pdf["cells"])) - len(c)) for c in pdf["cells"]])
        rows, cols = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links = np.zeros((n, n), dtype=bool)
        for at in range(0, len(rows), 256):
            r = rows[at : at + 256]
            links[np.ix_(r, cols)] = x[r] @ x[cols].T >= limit
        links |= links.T
        np.fill_diagonal(links, False)
        # A pair is counted in one cell: the cell both live in, or else where one of them visits the other; if each
        # visits the other, in the lower of the two cells.
        links &= at_home[:, None] | at_home[None, :]
        elsewhere = np.zeros((n, n), dtype=bool)
        for c in cells.T:
            elsewhere |= c[:, None] == home[None, :]
        elsewhere &= at_home[:, None] & ~at_home[None, :] & (home < cell)[None, :]
        links &= ~(elsewhere | elsewhere.T)
        counts = links.astype(np.int64) @ copies
        label = np.arange(n)
        while True:  # labels of the block's own components
            new = np.minimum(label, [label[row].min() if row.any() else n for row in links])
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        joined, linked = np.flatnonzero(label != np.arange(n)), np.flatnonzero(counts)
        return pd.DataFrame({"a": np.concatenate([node[linked], node[joined]]), "b": pd.array([None] * len(linked) + node[label[joined]].tolist(), dtype="Int64"), "n": np.concatenate([counts[linked], np.zeros(len(joined), dtype=np.int64)])})

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, limit: float = 0.93, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row vec_id, n_links, component_id, kept.

    Rows are compared when their labels are equal and not null. A vector that is null, empty, zero, or holds null or
    non-finite components links with nothing: 0 links, its own component, kept. Vectors of different lengths never
    link. Repeated rows link with each other as other vectors do. An empty table gives no rows. Links found are those
    of cosine >= limit among nodes that meet in a cell; with one cell (few vectors) all are found.
    """
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & _usable(F.col("embedding")))
    rows = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", F.transform("embedding", lambda x: x + F.lit(0.0)))))
    nodes = rows.where("usable").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
    nodes, _ = materialize(spark, nodes, "vectors")
    n = nodes.count()
    k = max(1, min(MAX_CELLS, -(-n // CELL)))
    dims = nodes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 1
    take = max(k, min(SAMPLE, SAMPLE_NUMBERS // dim))
    reach = min(1.0, 4.0 * take / max(1, n))
    near = nodes.where((F.size("embedding") == dim) & (F.xxhash64("node") <= int(-(2.0**63) + reach * (2.0**64 - 2048))))
    sample = near.orderBy(F.xxhash64("node")).limit(take).select("embedding").toPandas()["embedding"].tolist()
    k = min(k, max(1, len(sample)))
    centroids = spherical_kmeans(unit(sample), k) if sample else np.ones((1, dim))
    placed = _assign(nodes.select("label", "node", "copies", "embedding"), centroids, probes)
    placed, _ = materialize(spark, placed, "placed")
    blocks = placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("nb"))
    dealt = placed.join(blocks, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    found = dealt.select("label", "cell", "lo", "hi", "block", "node", "copies", "embedding", "cells").groupBy("label", "cell", "lo", "hi").applyInPandas(_compare(limit), "a long, b long, n long")
    found, _ = materialize(spark, found, "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(spark, found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labelled = nodes.select("node", "copies", "least_id").join(components.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled, _ = materialize(spark, labelled, "labelled")
    least, _ = materialize(spark, labelled.groupBy("component").agg(F.min("least_id").alias("component_id")), "least-ids")
    result = labelled.join(least, "component").join(counts, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    result, _ = materialize(spark, result, "of-node")
    ids = rows.select("vec_id", "node")
    alone = ids.where("node is null").withColumns({"component_id": F.lit(None).cast("long"), "n_links": F.lit(None).cast("long")})
    out = ids.where("node is not null").join(result, "node", "left").unionByName(alone)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON r.c = p.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT m.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, m.id = m.c AS kept
FROM m LEFT JOIN n ON m.id = n.a
"""
