"""Matrix requests: a filter, fields and a feature kind give three frames (cells, values, features)."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from cellframe import fixed
from cellframe.catalog import StarCatalog
from cellframe.functions.predicates import (
    feature_kind,
    fields_of,
    mentions_species,
    to_column,
)
from cellframe.operators.star import Tables, inner_chain, left_chain
from cellframe.session import durable


# Columns of a selection besides its fields: the cell's bucket, and whether all inner dimensions were found.
_BUCKET = "selected!"
_WHOLE = "whole!"


class EmptyManifest(ValueError):
    """A bundle-list request names no bundle."""


class MissingBundles(ValueError):
    """A bundle-list request names bundles that are not loaded."""


def append_barcode(catalog: StarCatalog, fields: Iterable[str]) -> list[str]:
    """Fields of an MTX request, which always carries the barcode."""
    fields = list(fields)
    spellings = {catalog.barcode_column, catalog.public_names.get(catalog.barcode_column.partition(".")[2])}
    return fields if spellings.intersection(fields) else [*fields, catalog.barcode_column]


@dataclass(frozen=True)
class MatrixRequest:
    """A request over the tables of a catalogue.

    ``unique_dimensions`` lists dimensions whose key has been checked to be unique (see
    ``plans.audits.duplicate_keys``); joins to them are left out of ``cells()`` when nothing uses them.
    """

    catalog: StarCatalog
    tables: Tables
    filter: Mapping[str, Any] | None
    fields: tuple[str, ...] | None = None
    feature: str = "gene"
    species: str | None = None
    value_type: str | None = None
    format: str = "loom"
    unique_dimensions: Collection[str] = ()
    bundles: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.format not in fixed.FORMATS:
            raise ValueError(f"Unknown format {self.format}")
        feature_kind(self.feature, self.catalog)
        self._predicate()
        self.catalog.select(self.asked_fields)

    @property
    def asked_fields(self) -> list[str]:
        default = self.catalog.default_fields if self.bundles is None else self.catalog.bundle_fields
        fields = list(self.fields) if self.fields is not None else list(default)
        return append_barcode(self.catalog, fields) if self.format == "mtx" else fields

    def _predicate(self) -> Column | None:
        """Rows of the species that the filter lets through, where either is given."""
        parts = [self._is_species()] if self.species is not None else []
        if self.filter is not None:
            parts.append(to_column(self.filter, self.catalog))
        return reduce(and_, parts) if parts else None

    def _is_species(self) -> Column:
        table, column = self.catalog.locate(self.catalog.species_field)
        return F.col(f"{table}.{column}") == self.species

    def _narrow(self, chain: DataFrame) -> DataFrame:
        if self.bundles is not None:
            chain = chain.join(
                self.bundles.alias("wanted"),
                F.col(self.catalog.bundle_column) == F.col("wanted.bundle_uuid"),
                "left_semi",
            )
        predicate = self._predicate()
        return chain if predicate is None else chain.filter(predicate)

    def _used_dimensions(self) -> set[str]:
        tables = {s.table for s in self.catalog.select(self.asked_fields)}
        if self.filter is not None:
            tables |= {self.catalog.locate(name)[0] for name in fields_of(self.filter)}
        if self.species is not None:
            tables.add(self.catalog.locate(self.catalog.species_field)[0])
        if self.bundles is not None:
            tables.add(self.catalog.bundle_column.partition(".")[0])
        return self.catalog.ancestors(tables)

    def _kept_dimensions(self) -> set[str]:
        return {d.name for d in self.catalog.dimensions if d.name not in self.unique_dimensions} | (
            self._used_dimensions()
        )

    def cells(self) -> DataFrame:
        """``cellkey`` and the asked fields under their public names, one row per selected cell."""
        root = self.catalog.root
        chain = left_chain(self.catalog, self.tables, self._kept_dimensions())
        columns = [F.col(s.path).alias(s.output) for s in self.catalog.select(self.asked_fields)]
        return self._narrow(chain).select(F.col(f"{root}.{self.catalog.root_key}").alias("cellkey"), *columns)

    def expression(self) -> DataFrame:
        """``(cellkey, featurekey, exprvalue)`` of the selected cells and feature kind.

        Unlike in ``cells()`` every dimension joins inner, so a cell that misses one has no values.

        The keys of the selected cells are written first. Their size is then known when the join with the values
        is planned: a small selection is broadcast and the values, by far the largest table, are not shuffled. Over
        the tables of a store only those buckets of values are read in which selected cells lie.
        """
        return self._values_of(self._selected())

    def _selected(self, *columns: Column) -> DataFrame:
        """``cellkey`` of the cells whose values are asked for, their bucket, and ``columns``, written once."""
        catalog = self.catalog
        dimensions = None if self.bundles is None else catalog.bundle_dimensions
        chain = self._narrow(inner_chain(catalog, self.tables, dimensions))
        return durable(chain.select(*self._keys(), *columns), "selected")

    def _bucketed(self) -> bool:
        """Do cells and values say in which bucket they lie?"""
        return all(self.catalog.bucket in self.tables[t].columns for t in (self.catalog.root, self.catalog.values))

    def _keys(self) -> list[Column]:
        root = self.catalog.root
        key = F.col(f"{root}.{self.catalog.root_key}").alias("cellkey")
        return [key, F.col(f"{root}.`{self.catalog.bucket}`").alias(_BUCKET)] if self._bucketed() else [key]

    def selection(self) -> tuple[DataFrame, DataFrame]:
        """``cells()``, written once, and the values of these cells: one selection for both.

        A row of the selection also says whether each inner dimension of the values was found and where the values lie.
        A bundle list, whose values follow other dimensions than its cells, is selected once for each.
        """
        if self.bundles is not None:
            return durable(self.cells(), "cells"), self.expression()
        catalog = self.catalog
        chain = self._narrow(left_chain(catalog, self.tables))
        columns = [F.col(s.path).alias(s.output) for s in catalog.select(self.asked_fields)]
        whole = reduce(and_, (F.col(f"{d.name}.{d.key}").isNotNull() for d in catalog.dimensions))
        both = durable(chain.select(*self._keys(), whole.alias(_WHOLE), *columns), "selection")
        keys = [c for c in ("cellkey", _BUCKET) if c in both.columns]
        return both.drop(_BUCKET, _WHOLE), self._values_of(both.filter(F.col(_WHOLE)).select(*keys))

    def _values_of(self, selected: DataFrame) -> DataFrame:
        """Values of the selected cells with what ``selected`` says about them: one scan of the values."""
        catalog = self.catalog
        kept = (
            self.tables[catalog.features]
            .alias(catalog.features)
            .filter(feature_kind(self.feature, catalog))
            .select(F.col(catalog.feature_key).alias("featurekey"))
        )
        served = self.value_type or catalog.served_type
        values = self.tables[catalog.values]
        if _BUCKET in selected.columns:
            # At most one row for each bucket of the store. The comparison keeps all of them; Spark prunes partitions at
            # run time only by a side that a condition has narrowed.
            lie = selected.select(_BUCKET).distinct().filter(F.col(_BUCKET) >= fixed.NO_BUCKET)
            values = values.join(F.broadcast(lie), F.col(f"`{catalog.bucket}`") == F.col(_BUCKET), "left_semi")
        extra = [c for c in selected.columns if c not in ("cellkey", _BUCKET)]
        return (
            values
            .filter(F.col(catalog.value_type) == served)
            .select(
                F.col(catalog.value_cell).alias("cellkey"),
                F.col(catalog.value_feature).alias("featurekey"),
                F.col(catalog.value_column).alias("exprvalue"),
            )
            .join(kept, "featurekey")
            .join(selected.drop(_BUCKET), "cellkey")
            .select("cellkey", "featurekey", "exprvalue", *extra)
        )

    def features(self) -> DataFrame:
        """Feature rows of the asked kind and species, keyed by ``featurekey``."""
        frame = self.tables[self.catalog.features].alias(self.catalog.features)
        frame = frame.filter(feature_kind(self.feature, self.catalog))
        if self.species is not None:
            frame = frame.filter(F.col(self.catalog.feature_species) == self.species)
        return frame.withColumnRenamed(self.catalog.feature_key, "featurekey")

    def fingerprint(self) -> DataFrame:
        """One row ``(fingerprint, cells)``: equal for equal parameters and equal sets of selected cells.

        Key hashes are summed, so the result needs no order and each task sends a single row.
        """
        return fingerprint(self.cells().select("cellkey"), self.feature, self.format, self.asked_fields)

    def check_bundles(self) -> DataFrame:
        """One row ``(requested, loaded)``: distinct bundles of the list, and those found in the tables."""
        table, _, column = self.catalog.bundle_column.partition(".")
        wanted = self.bundles.select("bundle_uuid").distinct()
        loaded = self.tables[table].select(F.col(column).alias("bundle_uuid")).distinct()
        return wanted.join(loaded.withColumn("found", F.lit(1)), "bundle_uuid", "left").agg(
            F.count(F.lit(1)).alias("requested"), F.count("found").alias("loaded")
        )


def fingerprint(keys: DataFrame, feature: str, format_: str, fields: Iterable[str]) -> DataFrame:
    """MD5 over the parameters, the number of keys and the sums of both halves of the keys' 128-bit hashes."""
    key_hash = F.md5(F.col(keys.columns[0]).cast("string"))

    def total(start: int) -> Column:
        half = F.conv(F.substring(key_hash, start, 16), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(half), F.lit(0).cast("decimal(20,0)")).cast("string")

    cells = F.count(F.lit(1))
    parameters = F.lit("|".join([feature, format_, *fields]))
    return keys.agg(
        F.md5(F.concat_ws("|", parameters, cells.cast("string"), total(1), total(17))).alias("fingerprint"),
        cells.alias("cells"),
    )


def fan_out(request: MatrixRequest) -> dict[str, MatrixRequest]:
    """One request per species: all of them when the filter names a species, else only the default one."""
    catalog = request.catalog
    tree = request.filter
    named = tree is not None and mentions_species(tree, catalog)
    species = catalog.species if named else (catalog.default_species,)
    return {name: replace(request, species=name) for name in species}


def fan_out_cells(request: MatrixRequest) -> DataFrame:
    """The cells of every fanned-out request in one pass, told apart by a ``species`` column."""
    catalog = request.catalog
    _, column = catalog.locate(catalog.species_field)
    output = catalog.public_names[column]
    asked = catalog.select(request.asked_fields)
    cells = replace(request, fields=(*request.asked_fields, catalog.species_field)).cells()
    tagged = cells.withColumn("species", F.col(f"`{output}`")).filter(F.col("species").isin(*fan_out(request)))
    return tagged if any(s.output == output for s in asked) else tagged.drop(output)


def fan_out_expression(request: MatrixRequest) -> DataFrame:
    """The values of every fanned-out request in one scan, told apart by a ``species`` column."""
    table, column = request.catalog.locate(request.catalog.species_field)
    selected = request._selected(F.col(f"{table}.{column}").alias("species"))
    return request._values_of(selected.filter(F.col("species").isin(*fan_out(request))))


def bundle_request(
    catalog: StarCatalog, tables: Tables, bundles: DataFrame, fields: Iterable[str] | None = None, check: bool = True
) -> dict[str, MatrixRequest]:
    """Requests over a list of bundles, one per species; the list is a frame, so it may be long.

    The first column of ``bundles`` holds the bundle names, with or without a version.
    """
    names = F.split_part(F.col(bundles.columns[0]).cast("string"), F.lit("."), F.lit(1))
    table, column = catalog.locate(catalog.bundle_column)
    wanted = bundles.select(names.cast(catalog.data_type(table, column)).alias("bundle_uuid")).distinct()
    wanted = durable(wanted, "bundles")
    if check and wanted.isEmpty():
        raise EmptyManifest("no bundles in the request")
    requests = {
        species: MatrixRequest(
            catalog, tables, None, tuple(fields) if fields is not None else None, species=species, bundles=wanted
        )
        for species in catalog.species
    }
    if check:
        counts = next(iter(requests.values())).check_bundles().first()
        if counts["requested"] != counts["loaded"]:
            raise MissingBundles(f"{counts['loaded']} of {counts['requested']} bundles are loaded")
    return requests
