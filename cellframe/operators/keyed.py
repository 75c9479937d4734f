"""Row replacement and removal by key, and the newest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in ``new``, plus every new row. Applying it twice changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(frame: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the doomed ones."""
    return frame.join(doomed.select(key).distinct(), key, "left_anti")


def latest(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the greatest ``order`` values per key.

    An aggregate rather than a window: each task keeps one row per key before the shuffle, so a key that holds
    a large share of the rows costs no more than any other.
    """
    rank = F.struct(*(F.col(o) for o in order))
    rest = F.struct(*(F.col(c) for c in frame.columns if c != key))
    return (
        frame.groupBy(key)
        .agg(F.max_by(rest, rank).alias("newest"))
        .select(key, "newest.*")
        .select(*frame.columns)
    )


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, matched by column name."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def ordered_distinct(frame: DataFrame, column: str, order: Column) -> DataFrame:
    """Distinct values with the place where each first occurs."""
    return frame.groupBy(column).agg(F.min(order).alias("first_place"))
