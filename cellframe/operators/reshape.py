"""Between the long form of a matrix and its coordinates, sparse rows and dense rows.

``values`` frames have the columns ``cellkey``, ``featurekey`` and ``exprvalue``; ``features`` and ``cells``
are ordinal frames made by :func:`ordinals`.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from cellframe.session import durable, together

_ROW_BITS = 33  # monotonically_increasing_id puts the partition above this bit and the row below it


def ordinals(frame: DataFrame, key: str) -> DataFrame:
    """``(key, ordinal)``: 1-based places of the distinct keys in ascending order.

    The keys are range-partitioned and sorted, each task numbers its own rows, and the count of the partitions
    before is added. The numbered rows are written once, because the offsets and the rows must come from the
    same partitioning.
    """
    numbered = durable(
        frame.select(key)
        .distinct()
        .repartitionByRange(key)
        .sortWithinPartitions(key)
        .withColumn("place", F.monotonically_increasing_id()),
        "ordinals",
    ).select(
        key,
        F.shiftright("place", _ROW_BITS).alias("block"),
        F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("row"),
    )
    # At most one count per range partition comes back to the driver. As a literal it leaves the frame's size
    # estimate alone, so that a small axis is still broadcast by the joins that use it.
    counts = {row["block"]: row["count"] for row in numbered.groupBy("block").count().collect()}
    blocks = range(max(counts, default=0) + 1)
    before = list(accumulate((counts.get(block, 0) for block in blocks), initial=0))
    offset = F.get(F.lit(before), F.col("block").cast("int"))
    return numbered.select(key, (offset + F.col("row") + 1).cast("long").alias("ordinal"))


def axes(features: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordinals of ``featurekey`` and of ``cellkey``, numbered at the same time."""
    pairs = ((features, "featurekey"), (cells, "cellkey"))
    found = together(features.sparkSession, [lambda f=frame, k=key: ordinals(f, k) for frame, key in pairs])
    return found[0], found[1]


def cells_with_values(cells: DataFrame, values: DataFrame, key: str = "cellkey") -> DataFrame:
    """Cells that have at least one value; the others do not appear in an exported matrix."""
    return cells.join(values.select(key).distinct(), key, "left_semi")


def cells_without_values(cells: DataFrame, values: DataFrame, key: str = "cellkey") -> DataFrame:
    """Cells that an export leaves out."""
    return cells.join(values.select(key).distinct(), key, "left_anti")


def duplicates(values: DataFrame) -> DataFrame:
    """Pairs of cell and feature with more than one value."""
    return values.groupBy("cellkey", "featurekey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def one_per_pair(values: DataFrame, on_duplicate: str = "error", keys: Sequence[str] = ("cellkey", "featurekey")) -> DataFrame:
    """At most one value per cell and feature, or per ``keys``: a second one fails the job, or is summed.

    Repeats are reduced in the task that reads them, before anything is shuffled, and pairs are dealt out by cell and
    feature. So neither a cell nor a pair that holds a large share of the values meets in one task; what puts a
    cell's values together afterwards gets at most one for each feature.
    """
    if on_duplicate not in ("error", "sum"):
        raise ValueError(f"on_duplicate is 'error' or 'sum', not {on_duplicate!r}")
    pairs = values.groupBy(*keys)
    if on_duplicate == "sum":
        return pairs.agg(F.sum("exprvalue").alias("exprvalue"))
    message = F.concat(F.lit("more than one value for "), F.col("cellkey"), F.lit(" / "), F.col("featurekey"))
    single = F.when(F.col("n") == 1, F.col("exprvalue")).otherwise(F.raise_error(message))
    return pairs.agg(F.max("exprvalue").alias("exprvalue"), F.count(F.lit(1)).alias("n")).select(
        *keys, single.alias("exprvalue")
    )


def coordinates(
    values: DataFrame, features: DataFrame, cells: DataFrame, on_duplicate: str = "error"
) -> DataFrame:
    """Non-zero entries as ``(row, col, value)``: row is the feature's ordinal, col the cell's.

    Values of features or cells that have no ordinal are dropped.
    """
    return (
        one_per_pair(values, on_duplicate)
        .join(features.withColumnRenamed("ordinal", "row"), "featurekey")
        .join(cells.withColumnRenamed("ordinal", "col"), "cellkey")
        .filter(F.col("exprvalue") != 0)
        .select("row", "col", F.col("exprvalue").alias("value"))
    )


def cell_entries(values: DataFrame, features: DataFrame, on_duplicate: str) -> DataFrame:
    """Per cell its listed features, sorted: one array no longer than the feature axis."""
    listed = one_per_pair(values, on_duplicate).join(
        features.select("featurekey", F.col("ordinal").cast("int").alias("row")), "featurekey", "left"
    )
    entry = F.when(F.col("row").isNotNull(), F.struct("row", F.col("exprvalue").alias("value")))
    return listed.groupBy("cellkey").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def sparse_rows(values: DataFrame, features: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """Per cell the ordinals and values of its non-zero features, in ascending order."""
    kept = F.filter("entries", lambda e: e["value"] != 0)
    return cell_entries(values, features, on_duplicate).select(
        "cellkey",
        F.transform(kept, lambda e: e["row"]).alias("indices"),
        F.transform(kept, lambda e: e["value"]).alias("values"),
    )


def _gap(entries: Column, i: Column) -> Column:
    """Number of absent features between entry ``i`` and the one before it."""
    previous = F.coalesce(F.get(entries, i - 1)["row"], F.lit(0))
    return F.get(entries, i)["row"] - previous - 1


def _tail(entries: Column, width: int) -> Column:
    return F.lit(width) - F.coalesce(F.get(entries, F.size(entries) - 1)["row"], F.lit(0))


def dense_rows(
    values: DataFrame, features: DataFrame, width: int, on_duplicate: str = "error"
) -> DataFrame:
    """Per cell one array of ``width`` values in feature order, zero where absent.

    Runs of zeros are filled between neighbouring entries, so a row costs its width once, not a look-up per
    feature.
    """
    entries = F.col("entries")
    zero = F.lit(0.0)
    filled = F.flatten(
        F.transform(
            entries,
            lambda e, i: F.concat(F.array_repeat(zero, _gap(entries, i)), F.array(e["value"].cast("double"))),
        )
    )
    return cell_entries(values, features, on_duplicate).select(
        "cellkey", F.concat(filled, F.array_repeat(zero, _tail(entries, width))).alias("values")
    )


def dense_line(width: int, separator: str = ",") -> Column:
    """Text of a cell's entries (see :func:`cell_entries`): its key and ``width`` values, ``0`` where absent.

    A cell without entries is all zeros.
    """
    zero = F.lit(f"{separator}0")
    body = F.array_join(
        F.transform(
            F.col("entries"),
            lambda e, i: F.concat(
                F.repeat(zero, _gap(F.col("entries"), i)), F.lit(separator), e["value"].cast("string")
            ),
        ),
        "",
    )
    tail = F.repeat(zero, _tail(F.col("entries"), width))
    return F.concat(F.col("cellkey").cast("string"), F.coalesce(body, F.lit("")), tail)


def dense_lines(
    values: DataFrame, features: DataFrame, width: int, separator: str = ",", on_duplicate: str = "error"
) -> DataFrame:
    """``(cellkey, line)``: per cell one text line of its dense row."""
    return cell_entries(values, features, on_duplicate).select("cellkey", dense_line(width, separator).alias("line"))


def nonzero_entries(values: Column) -> Column:
    """The ``(position, exprvalue)`` pairs of a dense row that are not zero."""
    pairs = F.transform(values, lambda v, i: F.struct(i.cast("int").alias("position"), v.alias("exprvalue")))
    return F.filter(pairs, lambda e: e["exprvalue"] != 0)


def entries_to_long(rows: DataFrame, axis: DataFrame, by: tuple[str, ...] = (), entries: str = "entries") -> DataFrame:
    """One row per entry, with the feature ``axis`` names at its ``position``.

    ``axis`` is per value of the ``by`` columns where sources have axes of their own.
    """
    kept = [c for c in rows.columns if c != entries]
    return rows.select(*kept, F.inline(entries)).join(axis, [*by, "position"])


def dense_to_long(rows: DataFrame, axis: DataFrame, by: tuple[str, ...] = (), values: str = "values") -> DataFrame:
    """Dense rows to one row per non-zero value; zeros are dropped before anything else."""
    return entries_to_long(rows.withColumn(values, nonzero_entries(F.col(values))), axis, by, values)


def nonzero_count(values: Column) -> Column:
    """Number of non-zero entries of a dense row."""
    return F.size(F.filter(values, lambda v: v != 0))
