"""Delimited text whose parts, concatenated in name order, are one file with one header."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cellframe.functions.text import long_boolean


def write_lines(
    rows: DataFrame,
    path: str,
    order: Sequence[str],
    line: Column,
    header: DataFrame | None = None,
    compression: str = "none",
) -> None:
    """Write ``line`` of every row in the given order, after the header lines (``place``, ``title``).

    Rows are range-partitioned by the order columns, so no task holds more than its share and part names follow
    the order. The text is built after that shuffle: only the row's columns travel.
    """
    if header is None:
        header = rows.sparkSession.createDataFrame([], "place int, title string")
    titles = header.select(F.lit(0).alias("_section"), F.col("place").alias("_place"), F.col("title").alias("_title"))
    body = rows.withColumns({"_section": F.lit(1), "_place": F.lit(0), "_title": F.lit(None).cast("string")})
    keys = ["_section", "_place", *order]
    (
        body.unionByName(titles, allowMissingColumns=True)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(F.when(F.col("_section") == 0, F.col("_title")).otherwise(line).alias("line"))
        .write.option("compression", compression)
        .text(path)
    )


def one_line(frame: DataFrame, *lines: str) -> DataFrame:
    """A header of fixed lines."""
    return frame.sparkSession.createDataFrame(list(enumerate(lines)), "place int, title string")


def render(column: str, data_type: T.DataType) -> Column:
    """Text of a cell: booleans as True/False."""
    value = F.col(f"`{column}`")
    return (long_boolean(value) if isinstance(data_type, T.BooleanType) else value).alias(column)


def write_table(
    frame: DataFrame,
    path: str,
    columns: Sequence[str],
    order: Sequence[str],
    separator: str = ",",
    header: bool = True,
    compression: str = "none",
) -> None:
    """Write columns as delimited text, quoted where needed, missing values empty."""
    options = {"sep": separator, "nullValue": "", "emptyValue": ""}
    rendered = [render(c, frame.schema[c].dataType) for c in columns]
    # a row of nothing but missing values is separators alone; the text of such a row would be null
    blank = reduce(and_, (F.coalesce(value.cast("string"), F.lit("")) == "" for value in rendered))
    row = F.when(blank, F.lit(separator * (len(columns) - 1))).otherwise(F.to_csv(F.struct(*rendered), options))
    titles = one_line(frame, separator.join(columns)) if header else None
    needed = list(dict.fromkeys([*columns, *order]))
    write_lines(frame.select(*(F.col(f"`{c}`") for c in needed)), path, order, row, titles, compression)
