"""WARC archives: one request, one response or revisit and one metadata record for each page, written as plain files,
and read back as one nested row per capture, joined through the records' concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cellframe.llm.frames import read_blobs, scratch, table, write_blobs
from cellframe.llm.registry import query
from cellframe.session import durable

#: Behind each file; gzip readers skip zeros at the end.
END = "\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, kind string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "payload_digest string, content_type string, http_head string, payload_bytes long, payload binary, "
    "fields map<string,string>"
)
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1: every five hex digits are four of base 32."""
    whole = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(whole, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _record(kind: str, record_id: str, date: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    return member.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + member.flush()


def _name(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(repr(parts).encode(), usedforsecurity=False).hexdigest())}>"


def _page_records(page_id, first, has_first, ordinal, url, digest, payload: bytes, date: str) -> list[bytes]:
    """The three records of a page; a revisit has the head of its response but no payload."""
    own = _name("capture", page_id, digest, ordinal)
    revisit = has_first and not (ordinal == 1 and page_id == first)
    uri = None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http_type = "application/http; msgtype="
    if revisit:
        of = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name("capture", first, digest, 1))]
        main = _record("revisit", own, date, [*shared, *of, ("Content-Type", http_type + "response")], http)
    else:
        main = _record("response", own, date, [*shared, ("Content-Type", http_type + "response")], http + payload)
    target = urlsplit(uri or "")
    asked = f"GET {target.path or '/'}{'?' + target.query if target.query else ''} HTTP/1.1\r\nHost: {target.netloc}\r\n\r\n".encode()
    tied = [("WARC-Concurrent-To", own), ("WARC-Target-URI", uri)]
    request = _record("request", _name("request", page_id, digest, ordinal), date, [*tied, ("Content-Type", http_type + "request")], asked)
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    about = _record("metadata", _name("metadata", page_id, digest, ordinal), date, [*tied, ("Content-Type", "application/warc-fields")], fields)
    return [request, main, about]


def write_warc(
    pages: DataFrame,
    path: str,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    least_bytes: int = 0,
    file_bytes: int = 8 << 20,
) -> None:
    """Write the records of every page to files of about ``file_bytes`` under ``path``, each record a gzip member.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest id has the response and the
    others revisit it. A null payload is empty. A null id is larger than any other and leaves no page-id field. Rows
    with equal id and payload are captures of their own, of which the first by url is the smallest. Other columns are
    not read.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"), payload_digest(payload).alias("digest")
    )
    keys = {"unknown": F.col("id").isNull(), "key": F.coalesce("id", F.lit(0))}
    small = rows.filter(F.octet_length("payload") >= least_bytes).select("id", "digest")
    first = small.groupBy("digest").agg(F.min("id").alias("first"))
    decided = small.join(first, "digest").withColumns(keys).select(*keys, "digest", "first").distinct()
    placed = rows.withColumns(keys).join(decided.withColumn("has_first", F.lit(True)), [*keys, "digest"], "left")
    ordinal = F.row_number().over(Window.partitionBy(*keys, "digest").orderBy("url"))
    ready = placed.select("id", "first", F.coalesce("has_first", F.lit(False)), ordinal, "url", "digest", "payload")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[bytes] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                records = _page_records(*(batch.column(c)[k].as_py() for c in range(7)), date)
                ready += records
                size += sum(map(len, records))
                if size >= file_bytes:
                    yield pa.RecordBatch.from_pydict({"data": [b"".join(ready)]})
                    ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_pydict({"data": [b"".join(ready)]})

    write_blobs(ready.mapInArrow(files, "data binary"), path, END)


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of an archive, as ``RECORD``; a broken one raises with its place among the uncompressed bytes."""
    if data.startswith(b"\x1f\x8b"):
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in data[at:stop].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda name: headers.get(name, [None])[0]
        start, length = stop + 4, int(one("content-length") or -1)
        block = data[start : start + length]
        if length < 0 or len(block) != length or data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"a WARC record of wrong length at byte {at}")
        kind, content = one("warc-type"), one("content-type") or ""
        head, payload, fields = None, block, None
        if content.startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            head = top.decode("latin-1")
        elif content.startswith("application/warc-fields"):
            pairs = (line.partition(":") for line in block.decode().split("\r\n") if line)
            fields, payload = [(n.strip().lower(), v.strip()) for n, _, v in pairs], b""
        digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
        if kind == "response" and digest and base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != digest:
            raise ValueError(f"a payload that isn't that of its digest at byte {at}")
        yield {
            "record_id": one("warc-record-id"), "kind": kind, "concurrent_to": headers.get("warc-concurrent-to", []),
            "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"), "date": one("warc-date"),
            "payload_digest": digest, "content_type": content, "http_head": head, "payload_bytes": len(payload),
            "payload": payload, "fields": fields,
        }
        at = start + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under ``path``."""
    kinds = {n: pa.string() for n in ("record_id", "kind", "refers_to", "target_uri", "date", "payload_digest", "content_type", "http_head")}
    kinds |= {"payload_bytes": pa.int64(), "concurrent_to": pa.list_(pa.string()), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string())}
    names = [f.split()[0] for f in RECORD.split(", ")]
    schema = pa.schema([(n, kinds[n]) for n in names])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                ready, size = [], 0
                for record in parse_records(content.as_py()):
                    ready.append(record)
                    size += len(record["payload"])
                    if size > 4 << 20 or len(ready) == 2000:
                        yield pa.RecordBatch.from_pylist(ready, schema)
                        ready, size = [], 0
                yield pa.RecordBatch.from_pylist(ready, schema)

    return read_blobs(spark, path).mapInArrow(records, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """``(capture_id, record_id)``: the requests and metadata that belong to each response or revisit.

    A record belongs to a capture when either names the other as concurrent, or when it names a request that does.
    """
    named = records.select("record_id", "kind", F.explode("concurrent_to").alias("other"))
    main = F.col("kind").isin("response", "revisit")
    captures = records.filter(main).select(F.col("record_id").alias("capture_id"))
    forth = named.filter(~main).select("record_id", F.col("other").alias("capture_id"))
    back = named.filter(main).select(F.col("other").alias("record_id"), F.col("record_id").alias("capture_id"))
    direct = forth.join(captures, "capture_id", "left_semi").select("capture_id", "record_id").union(back.select("capture_id", "record_id"))
    over = direct.select("capture_id", F.col("record_id").alias("between"))
    indirect = forth.select("record_id", F.col("capture_id").alias("between")).join(over, "between").select("capture_id", "record_id")
    return direct.union(indirect).distinct()


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: its own fields, ``request`` and ``metadata`` (structs, null where there is
    none), and how many of each belong to it; of several the one with the smallest record id is shown.

    Without a ``payload`` column in ``records`` the rows have none. What is joined is the records without payloads, which
    are written once. A record id that occurs twice is two captures, with the same request and metadata.
    """
    heads = durable(records.drop("payload"), "record-heads")
    pairs = transactions(heads)

    def side(kind: str, *columns: str) -> DataFrame:
        own = heads.filter(F.col("kind") == kind).select("record_id", *columns)
        joined = pairs.join(own, "record_id").groupBy("capture_id")
        shown = F.min_by(F.struct("record_id", *columns), "record_id")
        return joined.agg(shown.alias(kind), F.count(F.lit(1)).alias(f"{kind}s")).withColumnRenamed("capture_id", "record_id")

    main = (records if "payload" in records.columns else heads).filter(F.col("kind").isin("response", "revisit"))
    found = main.drop("concurrent_to", "fields").join(side("request", "target_uri", "http_head"), "record_id", "left")
    found = found.join(side("metadata", "fields"), "record_id", "left")
    return found.withColumnRenamed("record_id", "capture_id").fillna(0, ["requests", "metadatas"])


def orphans(records: DataFrame) -> DataFrame:
    """Requests and metadata that belong to no capture."""
    others = records.filter(F.col("kind").isin("request", "metadata"))
    return others.join(transactions(records).select("record_id"), "record_id", "left_anti")


@query("op10_warc_transactions")
def op10_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, folder, "pages"), path)
    head = F.regexp_extract("http_head", r"(?im)^Content-Length: *(\d+)", 1)
    whole = F.when(F.col("kind") == "response", F.col("payload_bytes")).otherwise(head.try_cast("long"))
    found = captures(read_warc(spark, path).drop("payload")).select(
        F.col("metadata")["fields"]["page-id"].cast("long").alias("page_id"),
        whole.alias("payload_bytes"),
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("refers_to").alias("of"),
        "capture_id",
    )
    found = durable(found, "captures")
    responses = found.filter("record_type = 'response'").select(F.col("capture_id").alias("of"), F.col("page_id").alias("refers_to"))
    return found.join(responses, "of", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
