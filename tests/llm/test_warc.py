import base64
import gzip
import hashlib
import io

import pytest

from cellframe.llm.frames import read_blobs, scratch
from cellframe.llm.warc import captures, op10_warc_transactions, orphans, parse_records, read_warc, transactions, write_warc
from conftest_llm import SF, rows

ODD = [
    (3, "http://a b/\r\n?x", "same"), (1, None, "same"), (1, None, "same"), (None, "u", None), (None, "u", "same"), (7, "http://h/p?q=1", ""),
    (8, "x", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (9, "é", "naïve 中文 " * 20_000),
]


@pytest.fixture(scope="module")
def odd_records(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string").selectExpr("*", "'z' as digest", "'z' as first", "'z' as key")
    path = scratch(spark, "warc")
    write_warc(pages.repartition(2), path, file_bytes=1000)
    return read_warc(spark, path).cache()


def test_round_trip_of_odd_pages(odd_records):
    found = rows(captures(odd_records))
    assert len(found) == len(ODD) and all(r["requests"] == r["metadatas"] == 1 for r in found)
    page = lambda r: int(r["metadata"]["fields"].get("page-id", -1))
    payloads = sorted((page(r), bytes(r["payload"]).decode()) for r in found if r["kind"] == "response")
    assert payloads == sorted([(1, "same"), (7, ""), (8, ODD[6][2]), (9, ODD[7][2])])
    first = {r["capture_id"]: page(r) for r in found if r["kind"] == "response"}
    assert sorted((page(r), first[r["refers_to"]]) for r in found if r["kind"] == "revisit") == [(-1, 1), (-1, 7), (1, 1), (3, 1)]
    assert orphans(odd_records).count() == 0


def test_small_payloads_have_no_revisits(spark):
    path = scratch(spark, "warc")
    write_warc(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string"), path, least_bytes=3)
    kinds = {r["metadata"]["fields"]["page-id"]: r["kind"] for r in captures(read_warc(spark, path)).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_empty_table(spark):
    path = scratch(spark, "warc")
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert captures(read_warc(spark, path)).count() == 0


def test_records_are_joined_either_way_and_over_a_request(spark):
    schema = "record_id string, kind string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, content_type string, http_head string, payload_bytes long, payload binary, fields map<string,string>"
    make = lambda i, kind, *to: (i, kind, list(to), None, None, None, None, None, None, None, None, None)
    records = spark.createDataFrame(
        [make("r1", "response", "q1"), make("q1", "request"), make("m1", "metadata", "q1"), make("r2", "response"), make("q2", "request", "r2"),
         make("q3", "request", "r2"), make("q4", "request", "gone"), make("r3", "revisit")], schema)
    assert sorted(map(tuple, transactions(records).collect())) == [("r1", "m1"), ("r1", "q1"), ("r2", "q2"), ("r2", "q3")]
    found = {r["capture_id"]: (r["request"] and r["request"]["record_id"], r["requests"], r["metadatas"]) for r in captures(records).collect()}
    assert found == {"r1": ("q1", 1, 1), "r2": ("q2", 2, 0), "r3": (None, 0, 0)}
    assert [r["record_id"] for r in orphans(records).collect()] == ["q4"]


def test_files_are_gzip_members(spark):
    path = scratch(spark, "warc")
    write_warc(spark.createDataFrame([(1, "u", "ab")], "page_id long, url string, html string"), path)
    data = bytes(read_blobs(spark, path).first()["content"])
    assert data.count(b"\x1f\x8b\x08") == 3 and gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1\r\n") == 3


@pytest.mark.parametrize("data", [b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nWARC-Type: request\r\n\r\nabc\r\n\r\n"])
def test_broken_records_raise(data):
    with pytest.raises(ValueError):
        list(parse_records(data))


def test_query_equals_brute_force(spark):
    first, expected = {}, {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect():
        data = (r["html"] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        of = first.setdefault(digest, r["page_id"])
        new = of == r["page_id"]
        expected[r["page_id"]] = (len(data), digest, "response" if new else "revisit", None if new else of)
    found = {r[0]: tuple(r[1:]) for r in op10_warc_transactions(spark, SF).collect()}
    assert found == expected
