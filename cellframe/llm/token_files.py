"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file holds one segment, a run of documents in ascending ``doc_id`` order::

    header   magic "EFTOKENS", then big-endian: part u32, segment u32, documents u64, ids u64, null doc_ids u64,
             smallest doc_id i64, bytes of an id u32, bytes of the two codes u32 each
    bounds   Elias-Fano code of the documents' ends in the id array
    doc_ids  Elias-Fano code of the doc_ids above the smallest
    ids      little-endian unsigned ids
    one line feed

An Elias-Fano code of n ascending numbers below u keeps the low log2(u/n) bits of each as they are and the high bits in
unary, about 2 + log2(u/n) bits a number. The place of every 256th one-bit is kept beside it, so ``select(i)`` reads a
few bytes and no table of 64-bit offsets exists. ``index`` is a table of one row per segment with the ids before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellframe.llm.encode import default_tokenizer, encoder
from cellframe.llm.frames import read_blobs, running_total, scratch, table, write_blobs
from cellframe.llm.registry import query

MAGIC = b"EFTOKENS"
_HEADER = struct.Struct(">8sIIQQQqIII")
_CODE = struct.Struct("<BQQIII")
_STRIDE = 256


class EliasFano:
    """Ascending whole numbers (repeats allowed) in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """``values`` as ascending unsigned 64-bit integers."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, bits, pack(low), pack(high), ones[::_STRIDE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = _CODE.pack(self.low_bits, self.n, 0, len(self.low), len(self.high), len(self.places))
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        bits, n, _, low, high, places = _CODE.unpack_from(data)
        at = _CODE.size
        part = lambda kind, count, start: np.frombuffer(data, kind, count, start)
        return cls(n, bits, part(np.uint8, low, at), part(np.uint8, high, at + low), part("<u4", places, at + low + high))

    def select(self, i: int) -> int:
        """The i-th number, from the nearest kept place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, missing = int(self.places[i // _STRIDE]), i % _STRIDE
        byte, seen = start // 8, -bin(int(self.high[start // 8]) & ((1 << start % 8) - 1)).count("1")
        while seen + (count := bin(int(self.high[byte])).count("1")) <= missing:
            seen, byte = seen + count, byte + 1
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        place = 8 * byte + int(ones[missing - seen])
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        window = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little") >> first % 8
        return (place - i) << self.low_bits | window & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every number, unsigned 64-bit."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                values |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return values


class Segment:
    """One file: its documents' ids by position, found with two selects."""

    def __init__(self, data: bytes) -> None:
        magic, self.part, self.number, self.documents, n_ids, self.nulls, self.base, self.id_bytes, bounds, doc_ids = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEADER.size
        self.ends = EliasFano.from_bytes(memoryview(data)[at : at + bounds])
        self._doc_ids = EliasFano.from_bytes(memoryview(data)[at + bounds : at + bounds + doc_ids])
        self.array = np.frombuffer(data, f"<u{self.id_bytes}", n_ids, at + bounds + doc_ids)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.array[start:end]

    def doc_ids(self) -> list[int | None]:
        above = self._doc_ids.all() + np.uint64(self.base % (1 << 64))
        return [None] * self.nulls + above.astype(np.int64).tolist()


def segment_bytes(part: int, number: int, doc_ids: list[int | None], ids: list[bytes], id_bytes: int) -> bytes:
    """A segment of documents whose ids are little-endian unsigned 32-bit; ``doc_ids`` ascending, nulls first."""
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    above = known.astype(np.uint64) - np.uint64(base % (1 << 64))
    ends = np.cumsum([len(i) // 4 for i in ids])
    bounds, names = EliasFano.encode(ends).to_bytes(), EliasFano.encode(above).to_bytes()
    array = np.frombuffer(b"".join(ids), "<u4")
    head = _HEADER.pack(MAGIC, part, number, len(ids), len(array), len(ids) - len(known), base, id_bytes, len(bounds), len(names))
    return head + bounds + names + array.astype(f"<u{id_bytes}").tobytes()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None,
    id: str = "doc_id",
    text: str = "text",
    segment_ids: int = 1 << 22,
    segment_docs: int = 1 << 16,
) -> None:
    """Encode every text and write segments under ``path``/segments, and ``path``/index.

    Rows are ordered by ``id`` (nulls first), repeated ids by a hash of the text and then the text. A segment ends with
    the document that brings it to ``segment_ids`` ids or ``segment_docs`` documents, so a document is never cut and a
    task holds one segment at most. A null or empty text has no ids but its end id; other columns are not read; an
    empty table gives no segment.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "t").select("id", "t")
    last = b"" if end_id is None else struct.pack("<I", end_id)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer)
        width = coder.id_bytes if end_id is None or end_id < 1 << 16 else 4
        names, ids, size = [], [], 0
        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                ids.append(coder.ids(words.as_py()) + last)
                size += len(ids[-1]) // 4
                if size >= segment_ids or len(ids) >= segment_docs:
                    yield pa.RecordBatch.from_pydict({"data": [segment_bytes(part, number, names, ids, width)]})
                    names, ids, size, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pydict({"data": [segment_bytes(part, number, names, ids, width)]})
        coder.forget()

    write_blobs(ordered.mapInArrow(segments, "data binary"), f"{path}/segments")
    _index(spark, path).write.parquet(f"{path}/index")


def _number(content: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, start + 1, size)), 16, 10).cast("long")


def _index(spark: SparkSession, path: str) -> DataFrame:
    """``(part, segment, documents, ids, start)`` from the files' headers."""
    content = F.col("content")
    heads = read_blobs(spark, f"{path}/segments").select(
        _number(content, 8, 4).alias("part"),
        _number(content, 12, 4).alias("segment"),
        _number(content, 16, 8).alias("documents"),
        _number(content, 24, 8).alias("ids"),
    )
    parts = heads.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    before = running_total(parts, [], "part", "part_ids", "part_start").drop("part_ids")
    inside = running_total(heads, ["part"], "segment", "ids", "inside")
    return inside.join(before, "part").select("part", "segment", "documents", "ids", (F.col("part_start") + F.col("inside")).alias("start"))


def read_token_files(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``columns``.

    ``columns`` are made from ``ids`` (little-endian unsigned 32-bit) before anything is joined.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                segment = Segment(content.as_py())
                ends = segment.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                names = segment.doc_ids()
                for a in range(0, len(names), 2000):
                    ids = [segment.array[s:e].astype("<u4").tobytes() for s, e in zip(starts[a : a + 2000], ends[a : a + 2000])]
                    n = len(ids)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([segment.part] * n, pa.int64()),
                            "segment": pa.array([segment.number] * n, pa.int64()),
                            "doc_id": pa.array(names[a : a + n], pa.int64()),
                            "inside": pa.array(starts[a : a + n]),
                            "n_tokens": pa.array((ends - starts)[a : a + n]),
                            "ids": pa.array(ids, pa.binary()),
                        }
                    )

    rows = read_blobs(spark, f"{path}/segments").mapInArrow(
        documents, "part long, segment long, doc_id long, inside long, n_tokens long, ids binary"
    )
    rows = rows.select("part", "segment", "doc_id", "inside", "n_tokens", *columns)
    index = spark.read.schema("part long, segment long, start long").parquet(f"{path}/index")
    found = rows.join(index, ["part", "segment"])
    return found.withColumn("start", F.col("start") + F.col("inside")).drop("part", "segment", "inside")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path, default_tokenizer(), end_id=2)
    back = read_token_files(spark, path, F.crc32("ids").alias("ids_crc32"))
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")
