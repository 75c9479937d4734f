"""One value for several entities of a bundle.

All of these are min/max aggregates with map-side combine: no group is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def consensus(value: Column, otherwise: Column) -> Column:
    """The common value when every entity agrees (missing counts as a value), else ``otherwise``."""
    wrapped = F.struct(value.alias("v"))
    low, high = F.min(wrapped), F.max(wrapped)
    return F.when(low.eqNullSafe(high), low["v"]).otherwise(otherwise)


def single_or_blank(value: Column, suffix: str = "") -> Column:
    """The only distinct non-missing value with ``suffix``, else empty text."""
    low, high = F.min(value), F.max(value)
    return F.when(low == high, F.concat(low, F.lit(suffix))).otherwise("")


def representative(key: Column) -> Column:
    """The smallest key stands for all."""
    return F.min(key)
