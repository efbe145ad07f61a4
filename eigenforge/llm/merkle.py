"""Merkle manifest of a table (operator 13): trees of digests built and proved level by level, in DataFrame functions.

Each row is a leaf. Leaves are numbered within their tree, a level's nodes meet at their number divided by the fanout,
and a group's sorted digests are hashed into the parent. The trees' roots are the leaves of one more tree. Proofs go down
again: each level's join hands a node's proof on to its children, with what stands beside them put in front. So a level
is shuffled twice, and all levels together are a small multiple of the leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eigenforge.session import materialize, shuffle_partitions

FANOUT = 2
#: Levels whose joins are one job on the way down.
LEVELS_A_JOB = 4
#: tree, number within it, the tree's root, and what stands left and right of the path, from the node upwards.
_PROOF = ("tree", "idx", "subroot", "proof")
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields one after the other."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def tree_key(c: Column) -> Column:
    """A key without nulls that sorts as the column does bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _parent(kids: Column) -> Column:
    """Digest of digests, each as hex text."""
    return F.unhex(F.sha2(F.array_join(F.transform(kids, _hex), ""), 256))


def numbered(spark: SparkSession, rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """rows (with a column tree) with idx, from 0 in this order within the tree, and n, the rows of the tree.

    Rows are dealt by ranges of (tree, order), so a tree with most of the rows lies in many tasks; a range's rows are
    numbered apart and start where the ranges before it end. Rows equal in all of the order may be numbered either way.
    """
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "tree", *order).withColumn("part", F.spark_partition_id())
    ranged, _ = materialize(spark, ranged, "merkle-ranges")
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tree", "part", before.alias("before"), F.sum("c").over(of_tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    return ranged.withColumn("place", place).join(offsets, ["tree", "part"]).select(*rows.columns, (F.col("before") + F.col("place") - 1).alias("idx"), "n")


@dataclass(frozen=True)
class Forest:
    """Levels of trees that share a fanout. Level 0: tree, idx, n, digest and the leaves' own columns; the levels above:
    tree, idx, n, digest and kids, an array of (digest, the leaves' columns on level 1)."""

    levels: list[DataFrame]
    own: tuple[str, ...]
    fanout: int

    def roots(self) -> DataFrame:
        """tree, digest."""
        tops = [level.where("n = 1").select("tree", "digest") for level in self.levels]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out


def grow(spark: SparkSession, leaves: DataFrame, own: tuple[str, ...] = (), fanout: int = FANOUT) -> Forest:
    """Levels from leaves (tree, idx, n, digest, own columns), each a table in the shared folder; no leaves, no levels."""
    if fanout < 2:
        raise ValueError("fanout must be 2 at least")
    level, _ = materialize(spark, leaves.select("tree", "idx", "n", "digest", *own), "merkle-level-0")
    most = level.agg(F.max("n")).first()[0]
    levels = [level] if most else []
    while most and most > 1:
        kid = F.struct("idx", "digest", *(own if len(levels) == 1 else ()))
        groups = levels[-1].where("n > 1").groupBy("tree", F.expr(f"idx div {fanout}").alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.first("n").alias("n"))
        n = F.ceil(F.col("n") / fanout).cast("long")
        level = groups.select("tree", F.col("up").alias("idx"), n.alias("n"), _parent(F.transform("kids", lambda k: k["digest"])).alias("digest"), "kids")
        levels.append(materialize(spark, level, f"merkle-level-{len(levels)}")[0])
        most = -(-most // fanout)
    return Forest(levels, own, fanout)


def _beside(kids: Column, at: Column) -> Column:
    """Digests left and right of a child, one after the other."""
    joined = lambda part: F.aggregate(part, F.lit(b""), lambda a, k: F.concat(a, k["digest"]))
    left, right = F.slice(kids, F.lit(1), at), F.slice(kids, at + 2, F.greatest(F.size(kids) - at - 1, F.lit(0)))
    return F.struct(joined(left).alias("left"), joined(right).alias("right"))


def prove(spark: SparkSession, forest: Forest, above: DataFrame) -> DataFrame:
    """A row for each leaf: tree, idx, digest, own columns, subroot, proof (array of left, right, from the leaf upwards).

    above: tree, subroot, proof of the trees' roots.
    """
    own = [F.col(c) for c in forest.own]
    known = None  # proofs of the level's nodes
    for height in range(len(forest.levels) - 1, 0, -1):
        level = forest.levels[height]
        tops = level.where("n = 1").select("tree", "idx").join(above, "tree").select(*_PROOF)
        known = tops if known is None else known.unionByName(tops)
        if (len(forest.levels) - height) % LEVELS_A_JOB == 0:
            known, _ = materialize(spark, known, f"merkle-proofs-{height}")
        kids = level.select("tree", "idx", "kids").join(known, ["tree", "idx"]).select("tree", "idx", "subroot", "proof", "kids", F.posexplode("kids").alias("at", "kid"))
        columns = [F.col("kid.digest").alias("digest"), *[F.col(f"kid.{c}").alias(c) for c in forest.own]] if height == 1 else []
        known = kids.select("tree", F.col("kid.idx").alias("idx"), *columns, "subroot", F.array_prepend("proof", _beside(F.col("kids"), F.col("at"))).alias("proof"))
    alone = forest.levels[0].where("n = 1").join(above, "tree").select("tree", "idx", "digest", *own, "subroot", "proof")
    return alone if known is None else known.unionByName(alone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf (hex) and a proof lead to."""
    return F.aggregate(proof, leaf, lambda a, p: F.sha2(F.concat(_hex(p["left"]), a, _hex(p["right"])), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(_hex(p["left"]), _hex(p["right"]))), ""), 256)


def manifest(spark: SparkSession, docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT) -> DataFrame | None:
    """doc_id, lang's tree, leaf, subroot, root, proof, changed (the tampered leaf or null) for each row; None without rows.

    A tree for each lang, null among them; its leaves ascend by doc_id. Null ids come first, rows of one id in order of
    their digests; equal rows are leaves of their own. Fields may be null, empty or long: each is hashed with its length.
    tampered gives other values of fields where the condition holds. Other columns are not read.
    """
    fields = [docs[c] for c in _FIELDS]
    other = leaf_digest(*[(tampered or {}).get(c, docs[c]) for c in _FIELDS])
    changed = F.when(where if where is not None else F.lit(False), F.unhex(other))
    leaves = docs.select(tree_key(docs["lang"]).alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), F.unhex(leaf_digest(*fields)).alias("digest"), changed.alias("changed"))
    # a last place in the order for rows that are equal, so that these are dealt over tasks, too
    leaves, _ = materialize(spark, leaves.withColumn("seq", F.monotonically_increasing_id()), "merkle-leaves")
    trees = grow(spark, numbered(spark, leaves, ("doc_id", "digest", "seq")), ("doc_id", "changed"), fanout)
    if not trees.levels:
        return None
    subroots, _ = materialize(spark, trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), "merkle-subroots")
    top = grow(spark, numbered(spark, subroots, ("key",)), ("key",), fanout)
    root = top.roots().select(_hex(F.col("digest"))).first()[0]
    start = spark.range(1).select(F.lit("").alias("tree"), F.lit(None).cast("binary").alias("subroot"), F.array().cast("array<struct<left:binary,right:binary>>").alias("proof"))
    above = prove(spark, top, start).select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), "proof")
    above, _ = materialize(spark, above, "merkle-above")
    rows = prove(spark, trees, above)
    return rows.select("doc_id", "tree", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"), "proof", _hex(F.col("changed")).alias("changed"))


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_steps of each row; no rows for no rows.

    Rows whose id's crc32 is divisible by 7 are tampered with: 1 is added to n_chars, and the proof of the table as it was
    is folded with the leaf as it is. Rows without an id are left alone.
    """
    hit = F.pmod(F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")), F.lit(7)) == 0
    rows = manifest(spark, docs, {"n_chars": docs["n_chars"].cast("decimal(20,0)") + 1}, hit)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_steps long"
    if rows is None:
        return spark.createDataFrame([], schema)
    own = rows.select("*", folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return own.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.size("proof").cast("long").alias("n_steps"))


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: {bit})), 4294967295::BIGINT)"


_PLAIN = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END" for c in _FIELDS)
_OTHER = _PLAIN.replace("n_chars", "(n_chars + 1)")
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS t, sha256(concat({_PLAIN})) AS leaf,
         CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN sha256(concat({_OTHER})) ELSE sha256(concat({_PLAIN})) END AS other
  FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
lv(t, l, i, n, h) AS (
  SELECT t, 0, i, n, leaf FROM k
  UNION ALL SELECT t, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY t, l, i // 2, n),
sr AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
up(l, i, n, h) AS (
  SELECT 0, i, n, h FROM sr
  UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY l, i // 2, n),
a(t, doc_id, leaf, l, i, n, proof, f) AS (
  SELECT t, doc_id, leaf, 0, i, n, '', other FROM k
  UNION ALL
  SELECT a.t, doc_id, leaf, a.l + 1, a.i // 2, (a.n + 1) // 2, proof || coalesce(s.h, ''),
         sha256(CASE WHEN a.i % 2 = 0 THEN f || coalesce(s.h, '') ELSE s.h || f END)
  FROM a LEFT JOIN lv s ON s.t = a.t AND s.l = a.l AND s.i = xor(a.i, 1) WHERE a.n > 1),
b(doc_id, leaf, subroot, l, i, n, proof, f, steps) AS (
  SELECT doc_id, leaf, sr.h, 0, sr.i, sr.n, proof, f, a.l FROM a JOIN sr ON a.t = sr.t WHERE a.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, b.l + 1, b.i // 2, (b.n + 1) // 2, proof || coalesce(s.h, ''),
         sha256(CASE WHEN b.i % 2 = 0 THEN f || coalesce(s.h, '') ELSE s.h || f END), steps + 1
  FROM b LEFT JOIN up s ON s.l = b.l AND s.i = xor(b.i, 1) WHERE b.n > 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified, CAST(steps AS BIGINT) AS n_steps
FROM b, (SELECT h FROM up WHERE n = 1) r WHERE b.n = 1
"""
