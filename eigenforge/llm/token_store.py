"""Token-id output in binary segments with a shared zstandard dictionary (operator 1).

Layout of a segment (little-endian):
    magic "EFTS", u16 version, u8 bytes per id, u8 zero, 32 bytes SHA-256 of the dictionary (zeros: none),
    u32 documents, u64 tokens before it in its part,
    i64 document id each, u8 whether that id is there each, u32 tokens each, u64 end of each frame in the payload,
    payload: one zstandard frame a document.
So one document is read by its index entry and a frame of its own. Segments are rows of a Parquet table: Spark's
committer makes them appear whole or not at all, in any store Spark writes to, whatever executors are lost.
Parts are ranges of document ids; a part's segments are in ascending order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.llm.words import CACHE_LIMIT, no_gc
from eigenforge.llm.wordbpe import Splitter, byte_alphabet
from eigenforge.llm.frames import map_frames
from eigenforge.session import scratch_path, ship_package, shuffle_partitions

MAGIC, VERSION = b"EFTS", 1
_HEAD = struct.Struct("<4sHBB32sIQ")
_SEGMENT = "part int, segment int, first_doc long, n_docs int, n_tokens long, dict_hash string, data binary"


class LibraryEncoder:
    """The tokenizers library behind a bounded cache: its model sees each distinct word once; texts with unusual
    characters or special tokens go through the whole tokenizer."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        self.tok = self.split.tok
        self.model = self.tok.model
        self.type = np.dtype("<u2" if max(self.tok.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.stand_ins = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.stand_ins)
        return array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _learn(self, keys: set[str]) -> None:
        new = keys.difference(self.known)
        if len(self.known) + len(new) > CACHE_LIMIT:
            self.known = {w: self.known[w] for w in keys if w in self.known}
        with no_gc():
            parts = {key: self.split.words_of(key) for key in new}
            of = {word: self._word(word) for word in set().union(*parts.values())}
            self.known.update({key: of[words[0]] if len(words) == 1 else b"".join(map(of.__getitem__, words)) for key, words in parts.items()})

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        group: list[list[str] | bytes] = []
        held = 0
        for i, text in enumerate(texts):
            keys = self.split.chunks(text) if text else []
            if keys is None:
                keys = np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()
            group.append(keys)
            held += len(keys)
            if held >= 300_000 or i == len(texts) - 1:
                self._learn(set().union(*(k for k in group if not isinstance(k, bytes))))
                for k in group:
                    yield k if isinstance(k, bytes) else b"".join(map(self.known.__getitem__, k))
                group, held = [], 0


@lru_cache(maxsize=2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def train_dictionary(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, samples: int = 512, size: int = 64 << 10) -> bytes:
    """A dictionary trained on the serialized ids of `samples` documents, those with the smallest hashes of their ids.

    That bound is a parameter of the training alone. Too few or too small documents give no dictionary (empty bytes).
    """
    hashed = docs.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    reach = min(1.0, 4.0 * samples / max(1, docs.count()))  # few rows leave their tasks, however many tasks there are
    near = hashed.where(F.col("h") <= int(-(2.0**63) + reach * (2.0**64 - 2048))) if reach < 1 else hashed
    rows = near.where(F.length("text") > 0).orderBy("h", "doc_id", F.xxhash64("text")).limit(samples).select("text").collect()
    enc = _encoder(tokenizer)
    end = np.array([end_id], dtype=enc.type).tobytes()
    arrays = [ids + end for ids in enc.encode([r[0] for r in rows])]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, arrays)) // 8)), arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _pack(docs: list[tuple[int | None, int, bytes]], before: int, width: int, dict_hash: bytes) -> bytes:
    ids = np.array([d[0] if d[0] is not None else 0 for d in docs], dtype="<i8")
    there = np.array([d[0] is not None for d in docs], dtype="u1")
    counts = np.array([d[1] for d in docs], dtype="<u4")
    ends = np.cumsum([len(d[2]) for d in docs]).astype("<u8")
    head = _HEAD.pack(MAGIC, VERSION, width, 0, dict_hash, len(docs), before)
    return b"".join([head, ids.tobytes(), there.tobytes(), counts.tobytes(), ends.tobytes(), *(d[2] for d in docs)])


class Segment:
    """A reader of one segment."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, width, _, dict_hash, n, self.before = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment of this format")
        if dict_hash != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError("the segment was written with another dictionary")
        at = _HEAD.size
        self.ids = np.frombuffer(data, "<i8", n, at)
        self.there = np.frombuffer(data, "u1", n, at + 8 * n)
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.ends = np.frombuffer(data, "<u8", n, at + 13 * n)
        self.base, self.data = at + 21 * n, data
        self.type = np.dtype("<u2" if width == 2 else "<u4")
        self._reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document, from its own frame alone."""
        a, b = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        raw = self._reader.decompress(self.data[self.base + a : self.base + b], max_output_size=int(self.counts[i]) * self.type.itemsize)
        return np.frombuffer(raw, self.type)


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_bytes: int = 4 << 20, samples: int = 512, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Encode every whole text, append end_id and write segments under path/segments, the dictionary under path/dictionary.

    Null or empty texts give just end_id. Null ids come first; rows with equal ids are ordered by the text's hash and
    all kept. Other columns are ignored. Returns the dictionary.
    """
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(spark, rows, tokenizer, end_id, samples)
    dict_hash = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        end = np.array([end_id], dtype=enc.type).tobytes()
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, bytes]] = []
        raw = tokens = 0

        def flush() -> pd.DataFrame:
            data = _pack(held, before, enc.type.itemsize, dict_hash)
            return pd.DataFrame({"part": [part], "segment": [number], "first_doc": pd.array([held[0][0]], dtype="Int64"), "n_docs": [len(held)], "n_tokens": [tokens], "dict_hash": [dict_hash.hex()], "data": [data]})

        for pdf in batches:
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            for doc_id, body in zip(ids, enc.encode(pdf["text"].tolist())):
                body += end
                n = len(body) // enc.type.itemsize
                held.append((doc_id, n, press.compress(body)))
                raw, tokens = raw + len(body), tokens + n
                if raw >= segment_bytes or len(held) >= 8192:
                    yield flush()
                    before, number, raw, tokens = before + tokens, number + 1, 0, 0
                    held.clear()
        if held:
            yield flush()

    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    map_frames(ordered.select("doc_id", "text"), run, _SEGMENT).write.mode("overwrite").parquet(f"{path}/segments")
    spark.createDataFrame([(dict_hash.hex(), bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    return dictionary


def read_tokens(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before), n_tokens, and ids or their ids_crc32.

    Only one number per part goes through the driver; there are as many parts as the writer had partitions.
    """
    ship_package(spark)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    segments = spark.read.parquet(f"{path}/segments")
    totals = dict(segments.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, so_far = {}, 0
    for part in sorted(totals):
        base[part] = so_far
        so_far += totals[part]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, data in zip(pdf["part"], pdf["data"]):
                s = Segment(data, dictionary)
                counts = s.counts.astype("int64")
                out = pd.DataFrame({"doc_id": pd.array(s.ids, dtype="Int64"), "start": base[part] + s.before + np.cumsum(counts) - counts, "n_tokens": counts})
                out.loc[s.there == 0, "doc_id"] = pd.NA
                ids = (s.tokens(i).astype("<u4") for i in range(len(counts)))
                if digests:
                    yield out.assign(ids_crc32=[zlib.crc32(x.tobytes()) for x in ids])
                else:
                    yield out.assign(ids=[x.astype("int32") for x in ids])

    kind = "ids_crc32 long" if digests else "ids array<int>"
    return map_frames(segments.select("part", "data"), run, f"doc_id long, start long, n_tokens long, {kind}")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with that id, decompressing their frames alone."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    segments = spark.read.parquet(f"{path}/segments")
    before = segments.where((F.col("first_doc") < doc_id) | F.col("first_doc").isNull()).agg(F.max(F.struct(F.coalesce("first_doc", F.lit(-(1 << 63))), "part", "segment"))).first()[0]
    near = F.col("first_doc") == doc_id
    if before is not None:
        near = near | ((F.col("part") == before["part"]) & (F.col("segment") == before["segment"]))
    found = []
    for row in segments.where(near).orderBy("part", "segment").select("data").toLocalIterator():
        s = Segment(bytes(row[0]), dictionary)
        found += [s.tokens(int(i)).tolist() for i in np.flatnonzero((s.ids == doc_id) & (s.there == 1))]
    return found


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write, read back, and give doc_id, start, n_tokens and ids_crc32 from what the files hold."""
    path = scratch_path(spark, "tokens")
    write_tokens(spark, docs, path, tokenizer)
    return read_tokens(spark, path, digests=True)
