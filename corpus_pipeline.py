"""Corpus preparation in five stages, each an operator of eigenforge.llm: quality rules, line dedup, near-duplicate
documents, mixing to target weights, BPE encoding.

A stage's result is to be written before the next stage is called, as run() does: a stage's scratch tables are deleted
when the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.llm import bpe_trie, line_dedup, mixing, ngram_join, quality
from eigenforge.llm.catalog import tokenizer_path
from eigenforge.llm.slots import may_hold, slots_of
from eigenforge.session import drop_path, materialize, scratch_path, scratch_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_CARRY = ("lang", "source")
_left: dict[str, list[str]] = {}  # by session, scratch tables of the stage before


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark._jsparkSession.sessionUUID()
        for path in _left.pop(session, []):
            drop_path(spark, path)
        with scratch_scope() as paths:
            out = f(spark, docs, sf_dir)
        _left[session] = paths
        return out

    return run_stage


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents from doc_id, text, carried."""
    return df.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and with them null and empty texts; the others go on without the lines that failed. Each row
    is judged by itself, so repeated rows fare alike."""
    judged = quality.measure(docs, carry=_CARRY).where("kept")
    return _documents(judged.select("doc_id", F.col("clean_text").alias("text"), "carried"))


@_stage
def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has go; a document that loses all of its text goes with them. Null ids come
    last; rows equal in id and text are treated alike, and a null or empty text, which has no line to lose, stays."""
    out = line_dedup.dedup_lines(spark, docs, carry=_CARRY)
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike(quality.NON_SPACE)
    return _documents(out.where(~F.coalesce(emptied, F.lit(False))).select("doc_id", "text", "carried"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, null ids last; ties: by text.

    Rows are told apart one by one, so an id that occurs with several texts loses only those that are near copies, a null
    id is as good as any, and of rows that are equal one stays. Rows without a word are in no group and all stay.
    """
    numbered, _ = materialize(spark, docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups, _ = materialize(spark, ngram_join.similar_components(spark, numbered.select(F.col("row").alias("doc_id"), "text")), "groups")
    copies = groups.where("doc_id != component_id")
    members = copies.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    members = members.unionByName(copies.select(F.col("component_id").alias("row"), F.col("component_id").alias("component")).distinct())
    members, _ = materialize(spark, members, "members")
    keys = slots_of(members.select(F.xxhash64("row").alias("key")), "key")
    marked = may_hold(numbered.withColumn("key", F.xxhash64("row")), "key", keys, "maybe")
    some = marked.where("maybe").select("row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), "row").alias("rank"))
    stay = members.join(some, "row").groupBy("component").agg(F.min("rank").alias("rank")).select("rank.row")
    gone, _ = materialize(spark, members.select("row").join(stay, "row", "left_anti"), "gone")
    sure, rest = marked.where("not maybe"), marked.where("maybe").join(gone, "row", "left_anti")
    return sure.select(docs.columns).unionByName(rest.select(docs.columns))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; documents without a word are not taken. Rows equal in id and text count
    together: one of them comes as often as the mix takes them all."""
    copies = mixing.mix(spark, docs).groupBy("row_hash", F.col("doc_id").alias("id")).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    keyed = docs.withColumn("row_hash", mixing.row_hash(F.col("doc_id"), F.col("text"))).dropDuplicates(["row_hash", "doc_id"])
    taken = keyed.join(copies, (keyed["row_hash"] == copies["row_hash"]) & keyed["doc_id"].eqNullSafe(copies["id"]))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


@_stage
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, for each row of the mix; null counts as empty."""
    return bpe_trie.encode_digests(spark, docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near duplicates", near_duplicates),
    ("mixing", mixture),
    ("bpe encoding", bpe_encoding),
]
#: Mixing draws at random and encoding needs a tokenizer: no SQL has these rows; tests hold a brute-force run against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again. An empty table gives no rows; columns other
    than those of documents are not carried."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
