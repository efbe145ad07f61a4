import base64
import hashlib
import random

import pyspark.sql.functions as F
import pytest

from eigenforge.llm import warc
from eigenforge.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def brute(rows, least_bytes=0):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= least_bytes and body in first and page != first[body]
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://www.Example.org/b?x=1#f", "<p>é</p>"), (3, "https://a.example.org/", "<p>é</p>"), (9, None, None), (8, "not a url", ""), (7, "http://x/\r\nInjected: 1", "a\r\n\r\nWARC/1.0\r\n\r\nb"),
    (1, "http://h:99999/", "x" * 300_000), (2, "http://b.example.org/", "x" * 300_000), (2, "http://b.example.org/", "x" * 300_000), (None, "http://n/", "<p>é</p>"), (11, "http://n/", "\r\n\r\n"), (12, "http://n/", "\r\n\r\n"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("first", F.lit(1)).withColumn("n", F.lit("x"))
    got = warc.capture_index(spark, pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS, least)


def test_index_is_in_one_global_order(spark):
    rng = random.Random(10)
    rows = [(i, f"http://{rng.choice('abc')}.example.org/{rng.randrange(30)}", f"<p>{rng.randrange(50)}</p>") for i in range(400)]
    out = warc.capture_index(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    out.sort(key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in out]
    assert keys == sorted(keys) and len(keys) == 400
    assert warc.capture_index(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_are_warc(spark):
    import glob
    import gzip

    path = scratch_path(spark, "w")
    warc.write_archives(spark, spark.createDataFrame(ROWS[:5], SCHEMA), path)
    files = glob.glob(path.removeprefix("file:") + "/*.gz") or glob.glob(path.removeprefix("file://") + "/*.gz")
    records = [h for f in files for _, h, _ in warc.parse_records(gzip.open(f).read())]
    assert len(records) == 5 and all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(h) for h in records)
    assert all("Injected" not in h for h in records)


def test_loser_tree_merges():
    rng = random.Random(11)
    for k in range(9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


def test_url_keys():
    assert warc.url_key("http://www.Example.org/b?x=1#f") == "org,example)/b?x=1"
    assert warc.url_key("https://a.example.org:81") == "org,example,a:81)/"
