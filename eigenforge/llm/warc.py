"""WARC archives and their index, merged from sorted runs (operator 10).

Records are written by Spark's own text writer: a record is text, and the blank line that ends it is the line
separator, so files are whole gzip-compressed WARC files in any store, committed by Spark. Reading parses records by
their lengths. Each reading task's captures become a run sorted by URL key, time and page; runs are cut by ranges of
that order, and a loser tree merges the slices of a range, so the index is in one global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.llm.frames import map_frames
from eigenforge.llm.slots import may_hold, slots_of
from eigenforge.session import materialize, scratch_path, ship_package, shuffle_partitions

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: First capture, in seconds; a page is captured page_id seconds later, within a span of about three years.
EPOCH, SPAN = 1_600_000_000, 100_000_000
#: Records in a file at most: what a reading task holds at once.
FILE_RECORDS = 4096
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_of_hex(digest: Column) -> Column:
    """A SHA-1 of 40 hex digits in base32: five hex digits are four characters."""
    letters = []
    for g in range(8):
        v = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(name: str, value: Column) -> list[Column]:
    return [F.lit(f"\r\n{name}: "), value]


def write_archives(spark: SparkSession, pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """A record for each page. Of equal payloads of at least min_revisit_bytes, the smallest page_id's is the response.

    A null html is an empty payload, a null url an empty target. A null page_id comes after all others. Repeated rows
    of the smallest page_id are all responses. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1(F.encode("html", "UTF-8")).alias("sha1"), F.octet_length("html").cast("long").alias("n"))
    equal = rows.where(F.col("n") >= min_revisit_bytes).groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null").select("sha1", "n", "first")
    equal, _ = materialize(spark, equal, "equal-payloads")
    key = F.xxhash64("sha1").alias("key")
    marked = may_hold(rows.select("*", key), "key", slots_of(equal.select(key), "key"), "maybe")
    alone = marked.where("not maybe").withColumn("first", F.lit(None).cast("long"))
    shared = marked.where("maybe").join(equal, ["sha1", "n"], "left")
    columns = ["page_id", "url", "html", "sha1", "n", "first"]
    rows = alone.select(columns).unionByName(shared.select(columns))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    id_of = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(HTTP), F.col("n").cast("string"), F.lit(END))
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        *_header("WARC-Record-ID", id_of(F.col("page_id"))),
        *_header("WARC-Date", when),
        *_header("WARC-Target-URI", target),
        *_header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(revisit, F.concat(*_header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), *_header("WARC-Refers-To", id_of(F.col("first"))))).otherwise(F.lit("")),
        *_header("Content-Type", F.lit("application/http; msgtype=response")),
        *_header("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))).cast("string")),
        F.lit(END),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, headers, block) of each record; blocks are cut by Content-Length, so they may hold anything."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        yield at, headers, view[start:stop]
        at = stop + 4


def url_key(url: str) -> str:
    """A sort-friendly key: host labels in reverse, then path and query, without scheme, www and fragment."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


class LoserTree:
    """A k-way merge of sorted sequences: inner nodes keep the loser of their match, so an item costs log k matches."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * self.k
        self.tree = [-1] * self.k  # tree[0]: the winner
        for leaf in range(len(runs)):
            self._play(leaf, True)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's next item comes before run b's; a run that is at its end comes last."""
        if self.at[b] >= len(self.runs[b]):
            return True
        return self.at[a] < len(self.runs[a]) and (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if building and self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs:
            run = self.tree[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._play(run)


_RUN = "run long, seq long, url_key string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, position long"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives: each reading task's are a run, numbered in their order. Response payloads are verified."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        page = lambda name: None if "none" in name else int(name.strip("<>").rpartition(":")[2])
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                for at, h, block in parse_records(gzip.decompress(content) if file.endswith(".gz") else content):
                    head = bytes(block[:200]).index(b"\r\n\r\n")
                    length = int(bytes(block[:head]).rpartition(b"Content-Length: ")[2])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        payload = block[head + 4 :]
                        if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{file}: the payload at {at} is damaged")
                    when = int(datetime.strptime(h["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
                    refers = page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    found.append((url_key(h["WARC-Target-URI"]), when, page(h["WARC-Record-ID"]), length, digest, h["WARC-Type"], refers, file, at))
        found.sort(key=lambda c: (c[0], c[1], c[2] is None, c[2] or 0))
        if found:
            out = pd.DataFrame(found, columns=["url_key", "captured", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "position"])
            out["page_id"], out["refers_to"] = (pd.array([c[i] for c in found], dtype="Int64") for i in (2, 6))
            out.insert(0, "seq", range(len(out)))
            out.insert(0, "run", TaskContext.get().partitionId())
            yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_frames(files, run, _RUN)


def merge_runs(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """One globally ordered index of the runs, range by range: range, place and the capture's columns."""
    ship_package(spark)
    columns = [c.split(" ")[0] for c in _RUN.split(", ")[2:]]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[int, list] = {}
        for pdf in batches:
            pages = pdf["page_id"].astype("Int64")
            keys = zip(pdf["url_key"], pdf["captured"], pages.isna(), pages.fillna(0))
            for number, key, row in zip(pdf["run"], keys, pdf[columns].itertuples(index=False)):
                slices.setdefault(number, []).append((key, tuple(row)))
        merged = [row for _, row in LoserTree([_Keyed.of(s) for _, s in sorted(slices.items())])]
        if merged:
            out = pd.DataFrame(merged, columns=columns)
            for c in ("page_id", "refers_to"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "place", range(len(out)))
            out.insert(0, "range", TaskContext.get().partitionId())
            yield out

    order = [F.col("url_key"), F.col("captured"), F.col("page_id").isNull(), F.col("page_id")]
    dealt = runs.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions("run", "seq")
    return map_frames(dealt, merge, "range long, place long, " + _RUN.split(", ", 2)[2])


class _Keyed(tuple):
    """A capture that compares by its key alone."""

    __slots__ = ()

    @staticmethod
    def of(rows: list) -> list:
        return [_Keyed(r) for r in rows]

    def __lt__(self, other) -> bool:
        return self[0] < other[0]

    def __eq__(self, other) -> bool:
        return self[0] == other[0]

    __hash__ = tuple.__hash__


def capture_index(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back, merge their index. An empty table gives an empty index."""
    path = scratch_path(spark, "warc")
    write_archives(spark, pages, path, min_revisit_bytes)
    runs, _ = materialize(spark, read_runs(spark, path), "runs")
    return merge_runs(spark, runs)


def digests(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return capture_index(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (
  SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(x, 5 * g + 1, 5) AS INT)) AS v FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(v, lambda n: substr('{BASE32}', n // 32768 + 1, 1) || substr('{BASE32}', n // 1024 % 32 + 1, 1)
           || substr('{BASE32}', n // 32 % 32 + 1, 1) || substr('{BASE32}', n % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
