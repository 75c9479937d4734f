"""Join chains along a star catalogue.

No join is hinted: dimensions below ``spark.sql.autoBroadcastJoinThreshold`` are broadcast because Spark has
checked their size, larger ones are shuffled, and adaptive execution splits hot keys of the shuffled side.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, functions as F

from cellframe.catalog import Dimension, StarCatalog

Tables = Mapping[str, DataFrame]


def _attach(frame: DataFrame, tables: Tables, dimension: Dimension, how: str) -> DataFrame:
    return frame.join(
        tables[dimension.name].alias(dimension.name),
        F.col(f"{dimension.parent}.{dimension.parent_key}") == F.col(f"{dimension.name}.{dimension.key}"),
        how,
    )


def left_chain(catalog: StarCatalog, tables: Tables, only: Collection[str] | None = None) -> DataFrame:
    """Every cell with its dimensions where present; required dimensions join inner.

    ``only`` leaves out the optional dimensions it does not name. That keeps the rows the same only for
    dimensions whose key is unique, so callers must have checked them.
    """
    frame = tables[catalog.root].alias(catalog.root)
    for dimension in catalog.dimensions:
        if dimension.name in catalog.required:
            frame = _attach(frame, tables, dimension, "inner")
        elif only is None or dimension.name in only:
            frame = _attach(frame, tables, dimension, "left")
    return frame


def inner_chain(catalog: StarCatalog, tables: Tables, names: Collection[str] | None = None) -> DataFrame:
    """Cells that have a row in every dimension, or in each of the named ones."""
    frame = tables[catalog.root].alias(catalog.root)
    for dimension in catalog.dimensions:
        if names is None or dimension.name in names:
            frame = _attach(frame, tables, dimension, "inner")
    return frame
