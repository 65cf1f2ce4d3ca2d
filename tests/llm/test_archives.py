import gzip  # noqa: F401  (a payload that names another format is data like any other)
import hashlib
import random
import time

import pytest
from conftest import same_as_duckdb
from pyspark.sql import functions as F

from sealwright.llm import warc
from sealwright.llm.registry import ORACLES, QUERIES

PAGES = "page_id long, url string, html string"


def test_same_rows_as_sql(spark):
    same_as_duckdb(spark, QUERIES["op11_warc"], ORACLES["op11_warc"])


def nasty(rng, k):
    """Payloads that hold whole records, ends of records and magic at every turn."""
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bits = [inner, "WARC/1.0\r\n", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n", "Content-Length: 3\r\n", "é漢", "x" * rng.randrange(40), inner * 3]
    return "".join(rng.choice(bits) for _ in range(k))


@pytest.mark.parametrize("block", [64, 777, 1 << 20])
def test_round_trip_of_payloads_that_look_like_records(spark, tmp_path, block):
    rng = random.Random(block)
    rows = [(i, f"http://h/{i}", nasty(rng, rng.randrange(30))) for i in range(60)] + [(90, "http://h/copy", "y" * 1000), (91, None, "y" * 1000), (92, "a\r\nWARC-Type: x", "y" * 1000), (93, "u", None), (94, "u", ""), (95, "u", "y" * 999), (96, "u", "y" * 999)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    root = warc.write_pages(pages, str(tmp_path / "a"))
    got = {int(r["record_id"].rsplit(":")[-1]): r for r in warc.read_archives(spark, root, block).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, url, html in rows:
        data, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        if i in (90, 91):
            assert r["record_type"] == "revisit" and r["refers_to"] == "urn:page:92" and r["payload"] is None
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]) == data and r["digest_matches"] and r["refers_to"] is None
    assert got[92]["target_uri"] == "a%0D%0AWARC-Type: x" and got[91]["target_uri"] is None
    assert warc.broken(spark, root, block).count() == 0


def test_candidates_are_more_than_records_and_jumping_keeps_the_chain(spark, tmp_path):
    inner = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = spark.createDataFrame([(i, "u", "\r\n\r\n" + inner * 50) for i in range(40)], PAGES).coalesce(1)
    root = warc.write_pages(pages, str(tmp_path / "a"), least=10**9)
    found = warc.candidates(spark, root, 500).cache()
    assert found.count() == 40 * 51
    reached = warc.entries(found)
    assert reached.groupBy("file", F.expr("offset div 500")).count().where("count > 1").count() == 0
    assert warc.read_archives(spark, root, 500).count() == 40


def test_broken_and_foreign_archives(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    digest = "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"body").digest()).decode()
    res = f"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: {digest}\r\ncontent-length:  4 \r\n\r\nbody\r\n\r\n".encode()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "whole.warc").write_bytes(good + res)
    (tmp_path / "a" / "cut.warc").write_bytes(good + res[:-6] + good)
    (tmp_path / "a" / "none.warc").write_bytes(b"nothing")
    (tmp_path / "a" / "empty.warc").write_bytes(b"")
    root = str(tmp_path / "a")
    assert {(r["path"], r["offset"]) for r in warc.broken(spark, root).collect()} == {("cut.warc", len(good)), ("none.warc", 0)}
    rows = {(r["file"], r["record_type"]): r for r in warc.read_archives(spark, root).collect()}
    assert set(rows) == {("whole.warc", "warcinfo"), ("whole.warc", "resource"), ("cut.warc", "warcinfo")}
    one = rows["whole.warc", "resource"]
    assert one["record_id"] == "urn:x" and one["digest_matches"] and bytes(one["payload"]) == b"body" and one["headers"]["content-length"] == "4"


def test_unusual_pages(spark, tmp_path):
    long = "é" * 3_000_000
    rows = [(1, "u", long), (2, "v", long), (None, "w", long), (None, "x", "z" * 1500), (None, "y", "z" * 1500), (3, "q", "r" * 1200), (3, "q", "r" * 1200), (3, "q", "r" * 1200)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("row", F.lit(1)).withColumn("payload", F.lit("no")).withColumn("key_", F.lit(2)).withColumn("keeper", F.lit(9))
    root = warc.write_pages(pages, str(tmp_path / "a"))
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in warc.read_archives(spark, root, 1 << 16).collect())
    assert got == sorted(
        [("urn:page:1", "revisit", "urn:page:2", 6_000_000), ("urn:page:2", "response", "", 6_000_000), ("urn:page:", "revisit", "urn:page:2", 6_000_000)]
        + [("urn:page:", "response", "", 1500)] * 2
        + [("urn:page:3", "response", "", 1200)] * 3
    )
    empty = warc.write_pages(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, empty).count() == 0 and warc.broken(spark, empty).count() == 0


def test_magic_without_end_takes_linear_time(tmp_path):
    data = b"WARC/1.1\r\nx: WARC/1.1\r\n" * 100_000
    (tmp_path / "f").write_bytes(data)
    began = time.time()
    with warc.Window(str(tmp_path), "f", len(data), 0, len(data)) as w:
        assert w.record(0) is None
    assert time.time() - began < 2
