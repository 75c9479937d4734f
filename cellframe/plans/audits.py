"""Checks of loaded tables: repeated keys, orphans, expected bundles, counts per bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellframe.catalog import StarCatalog
from cellframe.operators.star import Tables


def duplicate_keys(frame: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of keys held by more than one row: joins over such a key multiply rows."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_dimensions(catalog: StarCatalog, tables: Tables) -> set[str]:
    """Dimensions without a repeated key, safe to leave out of a left chain."""
    return {d.name for d in catalog.dimensions if duplicate_keys(tables[d.name], d.key).isEmpty()}


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key no parent row has."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(keys, child_key, "left_anti")


def missing_bundles(expected: DataFrame, analysis: DataFrame, column: str = "bundle_fqid") -> DataFrame:
    """Expected bundles without an analysis row; empty after a good load."""
    wanted = expected.select(F.col(expected.columns[0]).alias(column)).distinct()
    return wanted.join(analysis.select(column).distinct(), column, "left_anti")


def verify_load(expected: DataFrame, analysis: DataFrame, column: str = "bundle_fqid") -> DataFrame:
    """One row ``(expected, loaded, complete)``: analysis rows found for the expected bundles."""
    wanted = expected.select(F.col(expected.columns[0]).alias(column)).distinct()
    loaded = analysis.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return (
        wanted.join(loaded, column, "left")
        .agg(F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum("n"), F.lit(0)).alias("loaded"))
        .withColumn("complete", F.col("expected") == F.col("loaded"))
    )


def bundle_cells(catalog: StarCatalog, tables: Tables) -> DataFrame:
    """``(bundle, cellkey)``: the distinct cells of each bundle."""
    table, _, column = catalog.bundle_column.partition(".")
    dimension = catalog.dimension_by_name[table]
    owners = tables[table].select(F.col(dimension.key).alias("owner"), F.col(column).alias("bundle")).distinct()
    cells = tables[catalog.root].select(
        F.col(dimension.parent_key).alias("owner"), F.col(catalog.root_key).alias("cellkey")
    )
    return cells.join(owners, "owner").select("bundle", "cellkey").distinct()


def bundle_counts(catalog: StarCatalog, tables: Tables) -> DataFrame:
    """``(bundle, analyses, cells, values)`` per loaded bundle.

    Values are counted per cell before they meet the bundles, so one bundle with most of the values costs one
    row per cell and task.
    """
    table, _, column = catalog.bundle_column.partition(".")
    analyses = tables[table].groupBy(F.col(column).alias("bundle")).agg(F.count(F.lit(1)).alias("analyses"))
    per_cell = (
        tables[catalog.values]
        .groupBy(F.col(catalog.value_cell).alias("cellkey"))
        .agg(F.count(F.lit(1)).alias("values"))
    )
    inside = (
        bundle_cells(catalog, tables)
        .join(per_cell, "cellkey", "left")
        .groupBy("bundle")
        .agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("values"), F.lit(0)).alias("values"))
    )
    return analyses.join(inside, "bundle", "left").select(
        "bundle",
        "analyses",
        F.coalesce("cells", F.lit(0)).alias("cells"),
        F.coalesce("values", F.lit(0)).alias("values"),
    )
