"""Packing documents into sequences of a fixed window under a mixture.

Each source is a queue of documents in pieces. Deficit round robin serves the queues: in every round a source is given
credit for its share of a window, and sends the pieces that its credit covers; what is left is carried over. A piece
that ends at token e of its queue is therefore sent in round ceil(e / credit), whatever the other queues do, so rounds
need no simulation: pieces are put in order of round, source and place, and a running total over blocks of rounds gives
each its place in the stream of windows. Pieces are cut where a window ends.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cellframe.llm.encode import default_tokenizer, encoder
from cellframe.llm.frames import running_total, table
from cellframe.llm.registry import query
from cellframe.session import durable

_FIRST = (Window.unboundedPreceding, -1)


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, id: str, text: str, source: str) -> DataFrame:
    """``(id, source, task, inside, n, ids)`` in the order of the scan: ``inside`` counts the ids of the same source
    that the task met before; ``ids`` are little-endian in as few bytes as the vocabulary needs.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    last = b"" if end_id is None else struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(tokenizer), TaskContext.get().partitionId()
        width = coder.id_bytes if end_id is None or end_id < 1 << 16 else 4
        met: dict[str | None, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sources, inside, sizes, ids = batch.column(1).to_pylist(), [], [], []
                for name, words in zip(sources, batch.column(2)):
                    array = np.frombuffer(coder.ids(words.as_py()) + last, "<u4")
                    inside.append(met.get(name, 0))
                    sizes.append(len(array))
                    met[name] = inside[-1] + len(array)
                    ids.append(array.astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([task] * len(ids), pa.int64()), pa.array(inside, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())],
                    names=["id", "source", "task", "inside", "n", "ids", "width"],
                )
        coder.forget()

    return rows.mapInArrow(encode, "id long, source string, task long, inside long, n long, ids binary, width int")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None,
    window: int = 2048,
    targets: Mapping[str | None, float] | None = None,
    longest_piece: int = 256,
    rounds_per_block: int = 256,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pieces of every document: ``doc_id``, ``source``, ``start`` and ``length`` in the document's ids, ``ids``
    (little-endian unsigned, ``id_bytes`` each), ``doc_tokens``, ``sequence_id`` and ``offset`` there.

    ``targets`` gives sources their share of each window; by default each has its share of all ids, so that the queues
    end together. A source without a target has the smallest one given. Once a queue is empty the others fill the
    windows. Sources with a target of 0 are served after all others, each by its share of their ids. All sequences but the last are full, so it alone is padded. Pieces have at most ``longest_piece`` ids, so
    after any window a source is less than a piece from its target.

    The queue order is that of the scan. Null and empty texts have only their end id, and with no end id no piece; a
    null source is a queue of its own; repeated rows are documents of their own; other columns are not read.
    """
    spark = docs.sparkSession
    tokens = durable(encoded(docs, tokenizer, end_id, id, text, source), "encoded")
    per_task = durable(tokens.groupBy("source", "task").agg(F.sum("n").alias("task_ids")), "queues")
    totals = per_task.groupBy("source").agg(F.sum("task_ids").alias("ids"))
    weight = F.col("ids").cast("double")
    if targets is not None:
        if min(targets.values(), default=0) < 0:
            raise ValueError("a target is negative")
        given = spark.createDataFrame([(s, float(t)) for s, t in targets.items()], "name string, given double")
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("name")), "left")
        weight = F.coalesce("given", F.lit(float(min(targets.values(), default=0))))
    late = weight <= 0
    weight = F.when(late, F.col("ids")).otherwise(weight)
    credit = weight / F.sum(weight).over(Window.partitionBy(late)) * window
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    credits = totals.select("source", "ids", late.alias("late"), credit.alias("credit"), turn.alias("turn"))
    # late queues begin in the round after the others' last one
    last = F.max(F.when(~F.col("late"), F.ceil(F.col("ids") / F.col("credit")))).over(Window.partitionBy())
    begun = F.when(F.col("late"), F.coalesce(last, F.lit(0)) + 1).otherwise(0).cast("long")
    credits = credits.select(F.col("source").alias("of"), "credit", "turn", begun.alias("begun"))
    starts = running_total(per_task, ["source"], "task", "task_ids", "queue_start")
    starts = starts.join(credits, F.col("source").eqNullSafe(F.col("of")))
    starts = durable(starts.select(F.col("source").alias("of"), F.col("task").alias("by"), "queue_start", "credit", "turn", "begun"), "queue-starts")

    def pieces(rows: DataFrame) -> DataFrame:
        placed = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("task") == F.col("by"))).filter("n > 0")
        cut = placed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(longest_piece).cast("long"))))
        cut = cut.withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(longest_piece).cast("long")))
        place = F.col("queue_start") + F.col("inside") + F.col("start")
        ended = cut.withColumn("place", place).withColumn("round", F.col("begun") + F.ceil((F.col("place") + F.col("length")) / F.col("credit")))
        return ended.withColumn("block", F.floor(F.col("round") / rounds_per_block))

    block_ids = pieces(tokens.drop("ids")).groupBy("block").agg(F.sum("length").alias("block_ids"))
    blocks = durable(running_total(block_ids, [], "block", "block_ids", "block_start").select("block", "block_start"), "blocks")
    carried = pieces(tokens).withColumn("ids", F.substring("ids", (F.col("start") * F.col("width") + 1).cast("int"), (F.col("length") * F.col("width")).cast("int")))
    carried = carried.select("id", "source", "n", "start", "length", "ids", "width", "turn", "place", "round", "block")
    before = F.sum("length").over(Window.partitionBy("block").orderBy("round", "turn", "place").rowsBetween(*_FIRST))
    stream = carried.withColumn("before", F.coalesce(before, F.lit(0))).join(blocks, "block")
    stream = stream.withColumn("at", F.col("block_start") + F.col("before"))
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window)
    parts = stream.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    skipped = F.greatest(F.col("sequence_id") * window - F.col("at"), F.lit(0))
    ends = F.least((F.col("sequence_id") + 1) * window - F.col("at"), F.col("length"))
    parts = parts.withColumn("skipped", skipped.cast("long")).withColumn("took", (ends - skipped).cast("long"))
    ids = F.substring("ids", (F.col("skipped") * F.col("width") + 1).cast("int"), (F.col("took") * F.col("width")).cast("int"))
    return parts.select(
        F.col("id").alias("doc_id"),
        "source",
        (F.col("start") + F.col("skipped")).alias("start"),
        F.col("took").alias("length"),
        ids.alias("ids"),
        F.col("width").alias("id_bytes"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("at") + F.col("skipped") - F.col("sequence_id") * window).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, length)``: the pieces of each sequence put together; a sequence has at most a window of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b))
    return whole.select("sequence_id", joined.alias("ids"), F.aggregate("parts.length", F.lit(0).cast("long"), lambda a, b: a + b).alias("length"))


def with_crc32(packed: DataFrame) -> DataFrame:
    """``packed`` without its ids, but with ``ids_crc32`` of them as little-endian unsigned 32-bit integers."""
    import zlib

    columns = [c for c in packed.columns if c not in ("ids", "id_bytes", "ids_crc32")]
    rows = packed.select(*columns, "ids", "id_bytes")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(columns)
            widths = batch.column(k + 1).to_pylist()
            sums = [zlib.crc32(np.frombuffer(i, f"<u{w}").astype("<u4")) for i, w in zip(batch.column(k).to_pylist(), widths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(sums, pa.int64())], names=[*columns, "ids_crc32"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n in columns)
    return rows.mapInArrow(digest, f"{kinds}, ids_crc32 long")


@query("op5_deficit_packing")
def op5_deficit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(table(spark, folder, "documents"), default_tokenizer(), end_id=1)
    return with_crc32(packed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
