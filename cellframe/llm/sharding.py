"""Shards of near equal size from sampled splitters: keys are drawn with a chance in proportion to their row's size,
quantiles of the draw cut the key space into ranges, and ranges that turn out overfull are subdivided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cellframe.llm.frames import quoted, table
from cellframe.llm.registry import query
from cellframe.session import durable

_FIRST = (Window.unboundedPreceding, -1)


def splitters(rows: DataFrame, key: str, size: str, tie: str, ranges: int, samples_per_range: int = 16) -> DataFrame:
    """Ranges ``(range!, lo!, hi!)`` of ``key`` (long), each near the same total ``size``; at most three times ``ranges``.

    A row is drawn when a hash of ``key`` and ``tie`` falls below its size times ``ranges * samples_per_range`` over the
    total, so the draw has no more rows than that on average whatever the table's size, and reruns draw the same. A key
    that holds a whole range's share by itself gets a range of its own.
    """
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("t")).first()["t"]
    step = max(total, 1) / (ranges * samples_per_range)
    chance = F.shiftrightunsigned(F.xxhash64(key, tie, F.lit(17)), 11) / float(1 << 53)
    drawn = rows.filter(chance < F.col(size) / step).groupBy(F.col(key).alias("lo!")).agg(
        F.sum(F.greatest(F.col(size).cast("double"), F.lit(step))).alias("weight!")
    )
    share = F.sum("weight!").over(Window.partitionBy()) / ranges
    before = F.coalesce(F.sum("weight!").over(Window.orderBy("lo!").rowsBetween(*_FIRST)), F.lit(0.0))
    places = drawn.select("lo!", (F.col("weight!") >= share).alias("heavy!"), F.floor(before / share).alias("q!"))
    starts = places.filter(~F.col("heavy!")).groupBy("q!").agg(F.min("lo!").alias("lo!")).select("lo!")
    heavy = places.filter("`heavy!`").select(F.explode(F.array(F.col("lo!"), _next(F.col("lo!")))).alias("lo!"))
    lowest = rows.sparkSession.createDataFrame([(-(1 << 63),)], "`lo!` long")
    bounds = starts.union(heavy).union(lowest).distinct()
    order = Window.orderBy("lo!")
    return bounds.select(
        F.row_number().over(order).alias("range!"), "lo!", F.lead("lo!").over(order).alias("hi!")
    )


def _next(key):
    return F.when(key == (1 << 63) - 1, key).otherwise(key + 1)


def with_ranges(rows: DataFrame, key: str, ranges: DataFrame, bins: int = 4096) -> DataFrame:
    """``rows`` with ``range!``, the range their key lies in.

    The key space is cut into ``bins`` even bins, so that rows and ranges meet on equal bins; the broadcast side has at
    most one row for each range and bin together.
    """
    ends = rows.agg(F.min(key).cast("double").alias("a"), F.max(key).cast("double").alias("b")).first()
    low, width = ends["a"] or 0.0, max((ends["b"] or 0.0) - (ends["a"] or 0.0), 1.0)

    def bin_of(value):
        return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((value.cast("double") - low) / width * bins)))

    last = F.when(F.col("hi!").isNull(), bins - 1).otherwise(bin_of(F.col("hi!")))
    covered = ranges.withColumn("bin!", F.explode(F.sequence(bin_of(F.col("lo!")), last)))
    inside = (F.col(key) >= F.col("lo!")) & (F.col("hi!").isNull() | (F.col(key) < F.col("hi!")))
    return rows.withColumn("bin!", bin_of(F.col(key))).join(F.broadcast(covered), "bin!").filter(inside).drop("bin!", "lo!", "hi!")


def shard_by_size(
    rows: DataFrame, key: str, size: str, tie: str, shards: int, ranges_per_shard: int = 128, number: str | None = None
) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard); shards have near equal size.

    ``key`` and ``tie`` are long columns without nulls: rows of one key stay in one range, and so in one shard, unless
    their range holds over twice its share of the size or of the rows; such a range is subdivided by ``tie``, a hash
    that differs between the rows of a key, and, with ``number``, by that column, a number of its own for each row, so
    that fully repeated rows are spread as well. Repeated rows get slots of their own, in any order among themselves.
    An empty table gives no rows. Columns of ``rows`` named shard or slot are replaced; others are kept.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    wanted = shards * ranges_per_shard
    ranges = durable(splitters(rows, key, size, tie, wanted), "ranges")
    placed = with_ranges(rows, key, ranges)
    # At most three rows for each wanted range.
    totals = durable(placed.groupBy("range!").agg(F.sum(size).alias("bytes!"), F.count(F.lit(1)).alias("rows!")), "range-totals")
    all_bytes, all_rows = totals.agg(F.sum("bytes!"), F.sum("rows!")).first()
    share = max((all_bytes or 0) / wanted, 1.0), max((all_rows or 0) / wanted, 1.0)
    fullness = F.greatest(F.col("bytes!") / share[0], F.col("rows!") / share[1])
    parts = totals.select("range!", F.when(fullness > 2, F.ceil(fullness)).otherwise(1).cast("long").alias("parts!"))
    part = F.pmod(F.col(tie) if number is None else F.xxhash64(tie, number), F.col("parts!"))
    units = placed.join(F.broadcast(parts), "range!").withColumn("part!", part)
    sums = durable(units.groupBy("range!", "part!").agg(F.sum(size).alias("bytes!"), F.count(F.lit(1)).alias("rows!")), "units")
    order = Window.orderBy("range!", "part!").rowsBetween(*_FIRST)
    middle = F.coalesce(F.sum("bytes!").over(order), F.lit(0)) + F.col("bytes!") / 2
    shard = F.least(F.lit(shards - 1), F.floor(middle / (max(all_bytes or 0, 1) / shards))).cast("int")
    held = sums.select("range!", "part!", "rows!", shard.alias("shard"))
    first = F.sum("rows!").over(Window.partitionBy("shard").orderBy("range!", "part!").rowsBetween(*_FIRST))
    held = held.select("range!", "part!", "shard", F.coalesce(first, F.lit(0)).alias("first!"))
    place = F.row_number().over(Window.partitionBy("range!", "part!").orderBy(key, tie)) - 1
    numbered = units.withColumn("slot!", place).join(F.broadcast(held), ["range!", "part!"])
    return numbered.select(*quoted(rows.columns), "shard", (F.col("first!") + F.col("slot!")).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order across its files."""
    ordered = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


@query("op9_sampled_shards")
def op9_sampled_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    meta = table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("key"),
        F.xxhash64("doc_id", "text").alias("tie"),
    )
    numbered = durable(meta.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sharded = shard_by_size(numbered, "key", "size", "tie", shards=8, number="row")
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
