"""Mixing sources to target weights by pivotal dependent rounding (operator 2).

Each document of a source should be taken target / source size times. The whole part is given; the fraction is
rounded pivotally: two fractional documents exchange words, at random but without bias, until one of them is 0 or 1,
and the other goes on to the next. Words are what is exchanged, so a source's taken words stay at its target but for
the last document. Blocks of documents are rounded apart, each leaving at most one fractional document of a source;
these residuals meet in a reduction tree of fixed fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eigenforge.llm.frames import map_frames
from eigenforge.session import materialize, ship_package, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
#: Documents a block has about, and residual blocks that meet in a node of the tree.
BLOCK, FAN_IN = 8192, 64
#: Up to so many sources their targets are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def row_hash(doc_id: Column, text: Column, seed: int = 7) -> Column:
    """A row's identity in the mix."""
    return F.xxhash64(F.lit(seed), doc_id.cast("long"), text)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, target from (source, size): weighted shares of all sizes, capped, the excess reshared.

    Sources are ordered by code point, null last. The resharing ends when no source is above its cap: each capped
    source drops out with its cap and the rest share what remains by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per, _ = materialize(spark, per, "sources")
    # Ranks without one task for all sources: parts in order, then a count of the parts before.
    parts = per.repartitionByRange(shuffle_partitions(spark), F.col("source").isNull(), F.col("source")).select("*", F.spark_partition_id().alias("part"))
    parts, _ = materialize(spark, parts, "source-parts")
    counts = sorted(parts.groupBy("part").count().collect())
    base, so_far = [], 0
    for part, n in counts:
        base.append((part, so_far))
        so_far += n
    offsets = spark.createDataFrame(base, "part int, before long") if base else spark.createDataFrame([], "part int, before long")
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = parts.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.row_number().over(order) - 1).select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("cap"))
    ranked, _ = materialize(spark, ranked, "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1  # words for each unit of weight; sources at their cap
    while True:
        at_cap = F.col("weight") * F.lit(share) > F.col("cap")
        n, fixed, free = ranked.agg(F.count_if(at_cap), F.sum(F.when(at_cap, F.col("cap"))), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, share = n, (total - (fixed or 0.0)) / free
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(share), F.col("cap")).alias("target"))


def _uniform(seed: int, level: int, a: int, b: int) -> float:
    return xxhash.xxh3_64_intdigest(f"{seed}|{level}|{a}|{b}".encode()) / 2.0**64


def pivot(pa: float, sa: int, pb: float, sb: int, u: float) -> tuple[float, float]:
    """One exchange of words between two fractions: afterwards one of them is 0 or 1, and both are as expected before."""
    up, down = min((1 - pa) * sa, pb * sb), min(pa * sa, (1 - pb) * sb)  # words that a can gain, or lose
    if u * (up + down) < down:
        moved = up
    else:
        moved = -down
    qa, qb = pa + moved / sa, pb - moved / sb
    if moved > 0:  # exactly one bound was met; rounding errors must not leave both fractional
        qa, qb = (1.0, qb) if (1 - pa) * sa <= pb * sb else (qa, 0.0)
    else:
        qa, qb = (0.0, qb) if pa * sa <= (1 - pb) * sb else (qa, 1.0)
    return min(1.0, max(0.0, qa)), min(1.0, max(0.0, qb))


_ROWS = "source string, group long, row_hash long, doc_id long, size long, source_size long, target double, whole long, fraction double"


def _round_groups(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """Pivots fractional rows within each (group, source); at most one row of each stays fractional."""
    columns = [c.split(" ")[0] for c in _ROWS.split(", ")]
    at = {c: i for i, c in enumerate(columns)}
    share, size, name = at["fraction"], at["size"], at["row_hash"]

    def frame(out: list[list]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=columns)
        return pdf.assign(doc_id=pdf["doc_id"].astype("Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None  # the group at hand and its fractional row
        for pdf in batches:
            out = []
            for row in map(list, zip(*(pdf[c] for c in columns))):
                if (row[at["group"]], row[at["source"]]) != key:
                    key = (row[at["group"]], row[at["source"]])
                    out += [held] if held else []
                    held = row
                    continue
                if held is None:
                    held = row
                    continue
                held[share], row[share] = pivot(held[share], held[size], row[share], row[size], _uniform(seed, level, held[name], row[name]))
                if 0.0 < held[share] < 1.0:
                    out.append(row)
                else:
                    out.append(held)
                    held = row if 0.0 < row[share] < 1.0 else out.append(row)
            if out:
                yield frame(out)
        if held:
            yield frame([held])

    return map_frames(rows.sortWithinPartitions("group", "source", "row_hash", "doc_id"), run, _ROWS)


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document doc_id, row_hash, source, size, source_size, target, copies, taken (size times copies).

    A null text has size 0; documents of size 0 are taken 0 times. Null is a source of its own. Rows with equal ids
    are rounded each on its own; an empty table gives no rows. Reruns agree: blocks and draws depend on hashes of the
    rows, never on how they are dealt. A source whose words are all one document is rounded at random as one.
    """
    ship_package(spark)
    sized = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), words_in(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col), seed).alias("row_hash"))
    sized, _ = materialize(spark, sized, "sizes")
    targets, _ = materialize(spark, source_targets(spark, sized.select("source", "size"), weights, cap), "targets")
    n, n_sources = sized.count(), targets.count()
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    joined = sized.join(F.broadcast(t) if n_sources <= BROADCAST_SOURCES else t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).otherwise(0.0)
    rate = F.when(F.col("size") > 0, F.least(rate, F.lit(float(cap)))).otherwise(0.0)
    blocks = max(1, -(-n // BLOCK))
    rows = joined.select("source", F.pmod("row_hash", F.lit(blocks)).alias("group"), "row_hash", "doc_id", "size", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("fraction"))
    is_open = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    level, done = 0, [rows.where(~is_open)]
    rows = rows.where(is_open)
    while True:
        # by group and source, so the residuals of many sources meet in many tasks at the root, too
        parts = max(1, min(shuffle_partitions(spark), blocks * n_sources))
        out, _ = materialize(spark, _round_groups(rows.repartition(parts, "group", "source"), seed, level), f"round-{level}")
        done.append(out.where(~is_open))
        if blocks == 1:
            # At the root a source has one fractional document at most: a draw by its fraction.
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit("root"), "row_hash"), F.lit(1 << 52)) / F.lit(float(1 << 52))
            done.append(out.where(is_open).withColumn("fraction", F.when(u < F.col("fraction"), 1.0).otherwise(0.0)))
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
        rows = out.where(is_open).withColumn("group", F.expr(f"group div {FAN_IN}"))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    copies = (F.col("whole") + F.col("fraction").cast("long")).alias("copies")
    return result.select("doc_id", "row_hash", "source", "size", "source_size", "target", copies, (F.col("size") * copies).alias("taken"))
