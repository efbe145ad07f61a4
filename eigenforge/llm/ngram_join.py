"""Jaccard self-join of documents' word-shingle sets by PartEnum signatures (operator 7).

Sets are put into overlapping bands of about equal size. Within a band, sets that are similar enough differ in at most
k elements. The shingle domain is hashed into n1 first-level partitions of n2 second-level ones, and a signature covers
each subset of n2 - k2 second-level partitions of one first-level partition. With 2 * n1 > k some first-level partition
holds at most k2 = 1 differences, so similar sets share at least one signature: no link is lost.

Equal sets are one node. Sets that share a signature are compared exactly, in blocks of a bounded size: families of
near copies (sets whose signatures lead to the same set most often) stay together in a block, and a set goes to another
block only where a signature leads. Blocks give spanning forests, so pairs are never rows. A family too large for a
block is first held against its own center; what links there is one component and not compared within itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.llm.components import connected_components
from eigenforge.llm.frames import map_frames
from eigenforge.llm.slots import may_hold, slots_of
from eigenforge.llm.words import HashCache, ascii_words, mix
from eigenforge.session import materialize, ship_package

#: Words in a shingle, and the similarity in per cent, unless a caller says otherwise.
SHINGLE, PERCENT = 5, 80
_BAND_STEP = 1.5
#: Second-level partitions, and differences that a signature's first-level partition may hold.
N2, K2 = 2, 1
SPARE = 15
#: Sets and shingles that a block of an unsettled cluster has about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
#: Times that families join larger ones before sets are dealt to blocks.
MERGES = 2
_SALT, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, width: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole sequence as one if it has fewer words."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    total = np.full(n, np.uint64(len(h[:width])), dtype=np.uint64)
    for k in range(min(width, len(h))):
        total = mix(total * _MUL + h[k : k + n] + _SALT)
    return np.unique(total)


def node_of(s: np.ndarray) -> int | None:
    """A set's 64-bit hash; None for the empty set."""
    if not len(s):
        return None
    parts = np.array([len(s), np.bitwise_xor.reduce(mix(s ^ _SALT)), s.sum(dtype=np.uint64)], dtype=np.uint64)
    return int(mix(mix(parts[:1] * _SALT + parts[1:2]) + parts[2:])[0].astype(np.int64))


class Bands:
    """Bands of sizes [low, high], each with the differences k that similar sets in it can have."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def _low(self, j: int) -> int:
        while len(self.lows) <= j:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * _BAND_STEP)))
        return self.lows[j]

    def of(self, size: int) -> Iterator[tuple[int, int, int]]:
        """(band, k, most) of each band that a set of this size is in: that of its size, and those below whose partners
        reach it. most: differences it can have there with a similar set itself."""
        j = 0
        while self._low(j + 1) <= size:
            j += 1
        differences = lambda a, b: (a + b) * (100 - self.percent) // (100 + self.percent)
        while j >= 0:
            smaller = self._low(j + 1) - 1  # the smaller set of a pair of this band has at most this size
            high = smaller * 100 // self.percent
            if high < size:
                return
            other = size * 100 // self.percent if size <= smaller else smaller
            yield j, differences(smaller, high), differences(size, other)
            j -= 1


def signatures(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, int]:
    """PartEnum signatures of a set, in all its bands, and how many of them any set linked with it shares at least.

    Equal sets need none. There are SPARE per cent more partitions than similarity alone asks for, so that linked sets
    share several signatures and sets that share a passage seldom as many.
    """
    out, bound = [], None
    for band, k, most in bands.of(len(s)):
        if k == 0:
            continue
        need = k + 1
        n1 = -(-(need * (100 + SPARE) // 100 + 1) // N2)
        part = (mix(s * _MUL + _SALT) % np.uint64(n1 * N2)).astype(np.int64)
        sums, counts = np.zeros(n1 * N2, dtype=np.uint64), np.bincount(part, minlength=n1 * N2)
        np.add.at(sums, part, mix(s + _SALT))
        sums, counts = sums.reshape(n1, N2), counts.reshape(n1, N2)
        # A similar set equals this one on all but k partitions; with more than k that aren't empty, the empty ones
        # needn't be signed, as one of the others is equal too.
        filled = int((counts > 0).sum())
        for number, subset in enumerate(combinations(range(N2), N2 - K2)):
            place = (np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(number)) * np.uint64(4096) + np.uint64(band)
            sig = mix(mix(place + _SALT) + sums[:, subset].sum(axis=1, dtype=np.uint64))
            out.append(sig if filled < need else sig[counts[:, subset].sum(axis=1) > 0])
        bound = filled - most if bound is None else min(bound, filled - most)
    return (np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)), max(1, bound or 1)


def _sets(docs: DataFrame, width: int, columns: str, row) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seen = HashCache(), set()
        for pdf in batches:
            yield row(pdf, [shingle_set(t, width, cache) for t in pdf["text"]], seen)

    return map_frames(docs, run, columns)


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node and signatures of each row; of equal sets in a task the first alone has its signatures."""
    bands = Bands(percent)

    def row(pdf, sets, seen):
        ids, sigs, shares = [node_of(s) for s in sets], [], []
        for s, node in zip(sets, ids):
            known = node is None or node in seen
            if not known and len(seen) < 1_000_000:
                seen.add(node)
            found, least = (None, 0) if known else signatures(s, bands)
            sigs.append(found)
            shares.append(least)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": [len(s) for s in sets], "node": pd.array(ids, dtype="Int64"), "sigs": sigs, "shares": shares})

    return _sets(docs, width, "doc_id long, n_shingles long, node long, sigs array<long>, shares int", row)


def _members(docs: DataFrame, width: int) -> DataFrame:
    def row(pdf, sets, seen):
        return pd.DataFrame({"node": pd.array([node_of(s) for s in sets], dtype="Int64"), "shingles": [s.astype(np.int64) for s in sets]})

    return _sets(docs, width, "node long, shingles array<long>", row)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with whether they are similar enough, by their whole sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("n")).select("a", "b", (F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).alias("linked"))


def _block(percent: int):
    """Links within a block, or between two, as a spanning forest; a shingle adds one to all pairs of its sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        n, node = len(pdf), pdf["node"].to_numpy()
        size = np.array([len(x) for x in pdf["shingles"]])
        flat, owner = np.concatenate([np.asarray(x) for x in pdf["shingles"]]), np.repeat(np.arange(n), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        ends = np.r_[starts[1:], len(flat)]
        common = np.zeros((n, n), dtype=np.int32)
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            sets = owner[a:b]
            common[np.ix_(sets, sets)] += 1
        label = np.arange(n)
        while True:
            new = label.copy()
            for i in range(n):
                near = common[i] * 100 >= (size[i] + size - common[i]) * percent
                new[i] = min(label[i], label[near].min() if near.any() else n)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        joined = np.flatnonzero(label != np.arange(n))
        return pd.DataFrame({"src": node[joined], "dst": node[label[joined]]})

    return run


def _number_of_blocks() -> F.Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK_SETS))), F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES)))).cast("int")


def _able(spark: SparkSession, live: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """live (sig, node, pivot: the signature's least node) and facts of the nodes that can have a link at all.

    A linked set shares `shares` signatures at least, so a node that has fewer live ones has no link, however many other
    sets share a passage with it; and a signature that one node is left with leads nowhere.
    """
    able, _ = materialize(spark, live.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(facts, "node").where("c >= shares").drop("c"), "able")
    left = may_hold(live, "node", slots_of(able, "node"), "maybe").where("maybe").select("sig", "node").join(able.select("node"), "node", "left_semi")
    left, _ = materialize(spark, left, "able-signatures")
    pivots = left.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot != other").drop("other")
    return materialize(spark, left.join(pivots, "sig"), "able-live")[0], able


def _merged(spark: SparkSession, live: DataFrame, family: DataFrame) -> DataFrame:
    """Families (node, family, shares, others) after each has joined a larger one with which it shares as many
    signatures as its sets do with a set they are linked with.

    A signature proposes its largest family to all of its families, so the rows are as many as families have signatures.
    Families only say which sets meet in a block: however they are cut, the links found are the same.
    """
    rows = live.select("sig", "node").join(family.select("node", "family"), "node").select("sig", "family").distinct()
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.min("shares").alias("need"))
    kinds, _ = materialize(spark, rows.join(sizes, "family"), "kinds")
    tops, _ = materialize(spark, kinds.groupBy("sig").agg(F.max(F.struct("sets", "family")).alias("top"), F.count(F.lit(1)).alias("f")).where("f > 1").select("sig", F.col("top.family").alias("into")), "tops")
    met = kinds.join(tops, "sig").where("family != into").groupBy("family", "into").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
    step = met.where("c >= need").groupBy("family").agg(F.max_by("into", F.struct("c", "into")).alias("into"))
    # Each step leads to a larger family, or one of equal size and a larger id, so there are no circles.
    step, _ = materialize(spark, step, "steps")
    further = step.select(F.col("family").alias("into"), F.col("into").alias("last"))
    ends = step.join(further, "into", "left").select("family", F.coalesce("last", "into").alias("end"))
    moved = family.join(ends, "family", "left").withColumn("family", F.coalesce("end", "family")).select(family.columns)
    return materialize(spark, moved, "families")[0]


def _deal(spark: SparkSession, live: DataFrame, family: DataFrame, found: DataFrame) -> DataFrame:
    """node, lo, hi: the pairs of blocks in which a node meets others of its signatures.

    Blocks belong to a large settled component, to a large family, or to many small families; two blocks of one
    component need no comparison.
    """
    rows = family.join(found.withColumnRenamed("id", "node"), "node", "left")
    per = rows.where("component is not null").groupBy("component").agg(_number_of_blocks().alias("own")).where("own > 1")
    rows = rows.join(per.select("component", F.col("component").alias("settled"), "own"), "component", "left")
    sizes = rows.where("settled is null").groupBy("family").agg(_number_of_blocks().alias("nb"))
    total = rows.where("settled is null").agg(_number_of_blocks()).first()[0] or 1
    rows = rows.join(sizes, "family", "left")
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n)
    block = (
        F.when(F.col("settled").isNotNull(), F.xxhash64(F.lit("component"), "settled", part(F.col("own"))))
        .when(F.col("nb") > 1, F.xxhash64(F.lit("family"), "family", part(F.col("nb"))))
        .otherwise(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("family"), F.lit(total))))
    )
    placed, _ = materialize(spark, rows.select("node", "family", "shares", block.alias("block"), "settled"), "blocks")
    # A set goes to the blocks of a family with which it shares as many signatures as with a set it is linked with.
    members = live.select("sig", "node").join(placed.select("node", "family"), "node")
    kinds = members.select("sig", F.col("family").alias("to")).distinct()
    shared = members.select("sig", "node").join(kinds, "sig").groupBy("node", "to").agg(F.count(F.lit(1)).alias("n"))
    ends = placed.select(F.col("family").alias("to"), F.col("block").alias("other"), F.col("settled").alias("other_settled")).distinct()
    apart = F.col("settled").isNull() | F.col("other_settled").isNull() | (F.col("settled") != F.col("other_settled"))
    met = shared.join(placed.drop("family"), "node").where(F.col("n") >= F.col("shares")).join(ends, "to").where(apart)
    return met.select("node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).distinct()


def similar_components(spark: SparkSession, docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_shingles and component_id, the smallest doc_id that links lead to.

    Null or wordless texts have no shingles and link with nothing; their component is their own id. Equal texts are
    linked. Rows with equal ids count as one vertex of that id when their sets are equal, else as vertices of their
    own; a null id never is a component's smallest unless all are null. An empty table gives no rows.
    """
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own, _ = materialize(spark, signed(rows, width, percent), "signed")
    # Signatures of several nodes, by partial sums; few are, and a frequent one's rows may be split where they are joined.
    signs = own.select(F.explode("sigs").alias("sig"), "node")
    shared = signs.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot != other").drop("other")
    shared, _ = materialize(spark, shared, "shared-signatures")
    live = may_hold(signs, "sig", slots_of(shared, "sig"), "maybe").where("maybe").drop("maybe").join(shared.select("sig"), "sig").distinct()
    live, _ = materialize(spark, live, "live")
    facts = own.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.max("shares").alias("shares"))
    live, facts = _able(spark, live, facts)
    counted = live.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("family"))
    # A center's own center, twice: families of one group of near copies become one.
    for _ in range(2):
        up = counted.select(F.col("node").alias("family"), F.col("family").alias("higher"))
        counted, _ = materialize(spark, counted.join(up, "family", "left").select("node", F.coalesce("higher", "family").alias("family")), "centers")
    family, _ = materialize(spark, counted.join(facts, "node").select("node", "family", "doc_id", "n", "shares"), "families")
    for _ in range(MERGES):
        family = _merged(spark, live, family)

    def sets_of(some: DataFrame) -> DataFrame:
        """Whole sets of some nodes, a row each, from the documents that may hold them."""
        keys = slots_of(some.select(F.xxhash64("doc_id").alias("key")), "key")
        few = may_hold(rows.withColumn("key", F.xxhash64("doc_id")), "key", keys, "maybe").where("maybe").select("text")
        return _members(few, width).dropDuplicates(["node"])

    large = family.groupBy("family").agg(_number_of_blocks().alias("nb")).where("nb > 1").select("family")
    stars = family.join(large, "family").where("node != family").select(F.col("node").alias("a"), F.col("family").alias("b"))
    found = spark.createDataFrame([], "id long, component long")
    links = spark.createDataFrame([], "src long, dst long")
    if not stars.isEmpty():
        of_stars = family.join(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), "node")
        links, _ = materialize(spark, _verified(stars, sets_of(of_stars), percent).where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")), "stars")
        found = connected_components(spark, links)
    met = _deal(spark, live, family, found)
    in_blocks = met.join(sets_of(family), "node").groupBy("lo", "hi").applyInPandas(_block(percent), "src long, dst long")
    in_blocks, _ = materialize(spark, in_blocks, "links")
    found = connected_components(spark, links.unionByName(in_blocks))
    per_node = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    labelled = per_node.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled, _ = materialize(spark, labelled, "labelled")
    least, _ = materialize(spark, labelled.groupBy("component").agg(F.min("least_id").alias("component_id")), "least-ids")
    of_node, _ = materialize(spark, labelled.join(least, "component").select("node", "component_id"), "of-node")
    alone = own.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = own.where("node is not null").join(of_node, "node", "left")
    return alone.unionByName(linked.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+3], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON w.doc_id = m.id
"""
