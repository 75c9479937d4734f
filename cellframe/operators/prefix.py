"""Running totals over rows in a global order, without bringing the rows into one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellframe.session import durable

_ROW_BITS = 33  # monotonically_increasing_id puts the partition above this bit and the row below it


def in_order(frame: DataFrame, order: Sequence[str]) -> DataFrame:
    """``frame``, written once in ascending ``order``, with ``range!`` (the task that wrote a row) and ``place!`` in it.

    Rows are range-partitioned, so equal keys meet in one task and no task sees more than its range.
    """
    numbered = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place!", F.monotonically_increasing_id())
    return durable(numbered, "in-order").withColumn("range!", F.shiftright("place!", _ROW_BITS))


def running(ordered: DataFrame, **values: Column) -> DataFrame:
    """``ordered`` (of :func:`in_order`) with a column for each of ``values``: its sum over all rows before.

    Each range is summed by itself; one number per range and column comes to the driver and goes back as a literal.
    """
    names = list(values)
    sized = ordered.withColumns({f"{n}!": F.coalesce(c, F.lit(0)).cast("long") for n, c in values.items()})
    sums = {r["range!"]: r for r in sized.groupBy("range!").agg(*(F.sum(f"{n}!").alias(n) for n in names)).collect()}
    inside = Window.partitionBy("range!").orderBy("place!").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        totals = [sums[k][name] if k in sums else 0 for k in range(max(sums, default=-1) + 1)]
        offsets = F.lit(list(accumulate(totals, initial=0)))
        return F.get(offsets, F.col("range!").cast("int")) + F.coalesce(F.sum(f"{name}!").over(inside), F.lit(0))

    return sized.select(*ordered.columns, *(before(n).cast("long").alias(n) for n in names))


def group_ordinals(frame: DataFrame, group: str, key: str) -> DataFrame:
    """``(group, key, ordinal)``: 1-based places of the distinct keys of each group in ascending order.

    All groups are numbered at once: a key's place among all keys, less that of its group's first one.
    """
    ordered = in_order(frame.select(group, key).distinct(), [group, key])
    placed = durable(running(ordered, before=F.lit(1)).select(group, key, "before"), "placed")
    firsts = placed.groupBy(group).agg(F.min("before").alias("first!"))
    same = F.col("own!").eqNullSafe(F.col(group))
    return placed.join(firsts.withColumnRenamed(group, "own!"), same).select(group, key, (F.col("before") - F.col("first!") + 1).alias("ordinal"))


def whole_blocks(values: DataFrame, rows: int, cell: str = "cellkey") -> DataFrame:
    """``(cell, block, rows_before)``: a block for every cell of ``values``, so that no cell is split between blocks.

    Blocks are numbered from 0 in the order of the cells and hold at most ``rows`` rows, but for a cell with more rows,
    which is a block by itself. A cell with more than half of ``rows`` gets its own block; the others are cut by the
    place of their first row at every half of ``rows``, so that neighbours fill a block between half and whole.
    ``rows_before`` counts the rows of all cells before. A null cell is a cell and comes first.
    """
    half = max(1, rows // 2)
    sizes = values.groupBy(cell).agg(F.count(F.lit(1)).alias("n!"))
    large = F.col("n!") > half
    placed = running(in_order(sizes, [cell]), rows_before=F.col("n!"))
    placed = placed.withColumn("part!", F.when(large, -1).otherwise(F.call_function("div", F.col("rows_before"), F.lit(half))))
    # where a range of the order begins, the last row of the range before decides
    edges = placed.groupBy("range!").agg(F.max_by("part!", "place!").alias("part!"), F.max("place!").alias("place!")).collect()
    last = {r["range!"]: r["part!"] for r in edges}
    ends, known = [], None
    for k in range(max(last, default=-1) + 1):
        ends.append(known)
        known = last.get(k, known)
    carried = F.get(F.lit(ends).cast("array<long>"), F.col("range!").cast("int"))
    previous = F.coalesce(F.lag("part!").over(Window.partitionBy("range!").orderBy("place!")), carried)
    begins = (large | previous.isNull() | (previous != F.col("part!"))).cast("long")
    started = placed.withColumn("begins!", begins)
    counted = running(started, begun=F.col("begins!"))
    return counted.select(cell, (F.col("begun") + F.col("begins!") - 1).alias("block"), "rows_before")
