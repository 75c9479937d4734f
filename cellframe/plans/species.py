"""The matrices of all species of a request at once: one selection, one scan of the values, files parted by species."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from cellframe import fixed
from cellframe.functions.predicates import feature_kind
from cellframe.operators.prefix import group_ordinals
from cellframe.operators.reshape import one_per_pair
from cellframe.plans.request import MatrixRequest, fan_out, fan_out_cells, fan_out_expression
from cellframe.session import durable, together

_PAIR = ("species", "cellkey", "featurekey")


class SpeciesExport:
    """What ``MatrixExport`` makes of each request of :func:`fan_out`, for all of them together.

    Cells and features have ordinals within their species, in ascending order of keys; cells without values and values
    of features of another species are left out. A second value for a cell and feature fails the export or is summed.
    """

    def __init__(self, request: MatrixRequest, on_duplicate: str = "error") -> None:
        catalog = request.catalog
        self.values = durable(fan_out_expression(request), "species-values")
        features = request.tables[catalog.features].alias(catalog.features).filter(feature_kind(request.feature, catalog))
        features = features.withColumn("species", F.col(catalog.feature_species)).filter(F.col("species").isin(*fan_out(request)))
        self.features = durable(features.withColumnRenamed(catalog.feature_key, "featurekey"), "species-features")
        with_values = self.values.select("species", "cellkey").distinct()
        self.cells = durable(fan_out_cells(request).join(with_values, ["species", "cellkey"], "left_semi"), "species-cells")
        self.feature_ordinals, self.cell_ordinals = together(
            self.values.sparkSession,
            [lambda: group_ordinals(self.features, "species", "featurekey"), lambda: group_ordinals(self.cells, "species", "cellkey")],
        )
        self.on_duplicate = on_duplicate

    def coordinates(self) -> DataFrame:
        """``(species, row, col, value)`` of the non-zero values: row is the feature's ordinal, col the cell's."""
        pairs = one_per_pair(self.values, self.on_duplicate, _PAIR).filter(F.col("exprvalue") != 0)
        rows = self.feature_ordinals.withColumnRenamed("ordinal", "row")
        columns = self.cell_ordinals.withColumnRenamed("ordinal", "col")
        return pairs.join(rows, ["species", "featurekey"]).join(columns, ["species", "cellkey"]).select("species", "row", "col", F.col("exprvalue").alias("value"))

    def write_mtx(self, path: str) -> None:
        """``matrix.mtx``, ``genes`` and ``cells`` with a folder ``species=…`` each; parts in name order are a file.

        A species that the request names and that has no values has no folder.
        """
        entries = durable(self.coordinates(), "species-coordinates")
        sizes = [
            frame.groupBy("species").agg(F.count(F.lit(1)).alias(name))
            for frame, name in ((self.feature_ordinals, "rows"), (self.cell_ordinals, "cols"), (entries, "entries"))
        ]
        known = sizes[1].join(sizes[0], "species", "left").join(sizes[2], "species", "left").fillna(0)
        titles = known.select(
            "species", F.lit(0).cast("long").alias("col"),
            F.posexplode(F.array(F.lit(fixed.MTX_BANNER), F.concat_ws(" ", "rows", "cols", "entries"))).alias("row", "line"),
        )
        lines = entries.select("species", "col", "row", F.concat_ws(" ", "row", "col", F.col("value").cast("string")).alias("line"))
        together(
            entries.sparkSession,
            [
                lambda: _parted(lines.unionByName(titles.select("species", "col", F.col("row").cast("long"), "line")), ["col", "row"], os.path.join(path, "matrix.mtx"), "text"),
                lambda: _parted(self.features.join(self.feature_ordinals, ["species", "featurekey"]), ["ordinal"], os.path.join(path, "genes"), "parquet"),
                lambda: _parted(self.cells.join(self.cell_ordinals, ["species", "cellkey"]), ["ordinal"], os.path.join(path, "cells"), "parquet"),
            ],
        )


def _parted(rows: DataFrame, order: list[str], path: str, kind: str) -> None:
    """Rows in order within their species; ranges are cut over all species, so a large one is spread over several tasks."""
    keys = ["species", *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = ordered.drop(*order) if kind == "text" else ordered
    ordered.write.partitionBy("species").format(kind).save(path)
