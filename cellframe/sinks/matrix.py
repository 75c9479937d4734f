"""Matrix files: CSV, MatrixMarket, and the Loom layout as Parquet."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from cellframe import fixed
from cellframe.operators.reshape import axes, cell_entries, cells_with_values, coordinates, dense_line, sparse_rows
from cellframe.session import durable, together
from cellframe.sinks.delimited import one_line, write_lines, write_table


class MatrixExport:
    """The three frames of a request, aligned for writing.

    The frames are written to the shared folder first: ordinals, counts and files must all see the same rows.
    Cells without any value are left out unless ``include_empty_cells``.
    """

    def __init__(
        self,
        cells: DataFrame,
        values: DataFrame,
        features: DataFrame,
        on_duplicate: str = "error",
        include_empty_cells: bool = False,
    ) -> None:
        self.on_duplicate = on_duplicate
        self.include_empty_cells = include_empty_cells
        self.values, self.features, self.is_empty = together(
            values.sparkSession,
            [lambda: durable(values, "values"), lambda: durable(features, "features"), cells.isEmpty],
        )
        kept = cells if include_empty_cells else cells_with_values(cells, self.values)
        self.cells = durable(kept, "cells")
        self.feature_ordinals, self.cell_ordinals = axes(self.features, self.cells)

    @classmethod
    def of(cls, request, **options) -> MatrixExport:
        return cls(request.cells(), request.expression(), request.features(), **options)

    def _at_once(self, *actions: Callable[[], object]) -> list:
        return together(self.values.sparkSession, actions)

    def _by_cell(self, rows: DataFrame) -> DataFrame:
        """Rows per cell with the cell's ordinal; cells without a row stay only where empty cells are wanted."""
        return self.cell_ordinals.join(rows, "cellkey", "left" if self.include_empty_cells else "inner")

    def _feature_rows(self) -> DataFrame:
        return self.features.join(self.feature_ordinals, "featurekey")

    def _cell_rows(self) -> DataFrame:
        return self.cells.join(self.cell_ordinals, "cellkey")

    def _write_features(self, path: str, separator: str, compression: str) -> None:
        columns = ["featurekey", *(c for c in self.features.columns if c != "featurekey")]
        write_table(self._feature_rows(), path, columns, ["ordinal"], separator, True, compression)

    def _write_cells(self, path: str, separator: str, compression: str) -> None:
        columns = ["cellkey", *(c for c in self.cells.columns if c != "cellkey")]
        write_table(self._cell_rows(), path, columns, ["ordinal"], separator, True, compression)

    def _write_empty(self, path: str) -> None:
        nothing = self.values.sparkSession.createDataFrame([], "line string")
        nothing.write.text(path)

    def write_csv(self, path: str) -> None:
        """``expression.csv`` (cells by features), ``genes.csv`` and ``cells.csv``."""
        if self.is_empty:
            return self._write_empty(os.path.join(path, "expression.csv"))
        width = self.feature_ordinals.count()
        entries = cell_entries(self.values, self.feature_ordinals, self.on_duplicate)
        rows = self._by_cell(entries)
        # The title line names every feature, so it is as long as the format makes it.
        listed = F.array_sort(F.collect_list(F.struct("ordinal", F.col("featurekey").cast("string").alias("k"))))
        title = self.feature_ordinals.agg(
            F.concat_ws(",", F.lit("cellkey"), F.transform(listed, lambda e: e["k"])).alias("title")
        ).select(F.lit(0).alias("place"), "title")
        self._at_once(
            lambda: write_lines(rows, os.path.join(path, "expression.csv"), ["ordinal"], dense_line(width), title),
            lambda: self._write_features(os.path.join(path, "genes.csv"), ",", "none"),
            lambda: self._write_cells(os.path.join(path, "cells.csv"), ",", "none"),
        )

    def write_mtx(self, path: str) -> None:
        """``matrix.mtx.gz`` (features by cells) with ``features``, ``genes``, ``cells`` and ``barcodes`` tables."""
        if self.is_empty:
            return self._write_empty(os.path.join(path, "matrix.mtx.gz"))
        entries = durable(
            coordinates(self.values, self.feature_ordinals, self.cell_ordinals, self.on_duplicate), "coordinates"
        )
        sizes = self._at_once(self.feature_ordinals.count, self.cell_ordinals.count, entries.count)
        header = one_line(entries, fixed.MTX_BANNER, " ".join(map(str, sizes)))
        line = F.concat_ws(" ", "row", "col", F.col("value").cast("string"))
        tenx = features_10x(self._feature_rows())
        columns = [c for c in tenx.columns if c != "ordinal"]
        cells = self._cell_rows()
        place = {name: os.path.join(path, f"{name}.gz") for name in ("matrix.mtx", "features.tsv", "genes.tsv", "cells.tsv", "barcodes.tsv")}
        self._at_once(
            lambda: write_lines(entries, place["matrix.mtx"], ["col", "row"], line, header, "gzip"),
            lambda: write_table(tenx, place["features.tsv"], columns, ["ordinal"], "\t", False, "gzip"),
            lambda: self._write_features(place["genes.tsv"], "\t", "gzip"),
            lambda: self._write_cells(place["cells.tsv"], "\t", "gzip"),
            lambda: write_table(cells, place["barcodes.tsv"], ["barcode"], ["ordinal"], "\t", False, "gzip"),
        )

    def write_loom_layout(self, path: str) -> None:
        """Parquet tables ``matrix`` (one sparse column per cell), ``col_attrs``, ``row_attrs`` and ``attrs``."""
        if self.is_empty:
            nothing = self.values.sparkSession.createDataFrame([], "ordinal long, indices array<int>, values array<float>")
            return nothing.write.parquet(os.path.join(path, "matrix"))
        sparse = sparse_rows(self.values, self.feature_ordinals, self.on_duplicate)
        matrix = self._by_cell(sparse).select(
            "ordinal",
            F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
            F.coalesce(F.col("values").cast("array<float>"), F.array().cast("array<float>")).alias("values"),
        )
        columns = self._cell_rows().withColumnRenamed("cellkey", "CellID")
        rows = self._feature_rows()
        others = [c for c in rows.columns if c not in ("featurename", "ordinal")]
        rows = rows.select(
            "ordinal", F.col("featurekey").alias("Accession"), F.col("featurename").alias("Gene"), *others
        )
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), fixed.LOOM_TIMESTAMP)
        shape = self._at_once(self.feature_ordinals.count, self.cell_ordinals.count)
        attributes = matrix.sparkSession.createDataFrame([tuple(shape)], "rows long, columns long").select(
            now.alias("CreationDate"), F.lit(fixed.LOOM_SPEC_VERSION).alias("LOOM_SPEC_VERSION"), "rows", "columns"
        )

        def in_order(frame: DataFrame, name: str) -> None:
            ordered = frame.repartitionByRange("ordinal").sortWithinPartitions("ordinal")
            ordered.write.parquet(os.path.join(path, name))

        self._at_once(
            lambda: in_order(matrix, "matrix"),
            lambda: in_order(columns, "col_attrs"),
            lambda: in_order(rows, "row_attrs"),
            lambda: attributes.write.parquet(os.path.join(path, "attrs")),
        )

    def write(self, path: str, format_: str) -> None:
        """Write one of the served formats."""
        {"csv": self.write_csv, "mtx": self.write_mtx, "loom": self.write_loom_layout}[format_](path)


def features_10x(features: DataFrame) -> DataFrame:
    """Feature rows with the constant 10x feature type as third column."""
    rest = [c for c in features.columns if c not in ("featurekey", "featurename")]
    return features.select(
        "featurekey", "featurename", F.lit(fixed.FEATURE_TYPE_10X).alias("featuretype_10x"), *rest
    )


def matrix_size(features: DataFrame, cells: DataFrame, entries: DataFrame) -> DataFrame:
    """One row ``(features, cells, nonzero)``: the size line of a coordinate file."""
    counted = [
        frame.select(F.lit(tag).alias("tag")) for tag, frame in (("f", features), ("c", cells), ("n", entries))
    ]
    tags = counted[0].union(counted[1]).union(counted[2])
    return tags.agg(
        F.count_if(F.col("tag") == "f").alias("features"),
        F.count_if(F.col("tag") == "c").alias("cells"),
        F.count_if(F.col("tag") == "n").alias("nonzero"),
    )
