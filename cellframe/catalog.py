"""Star catalogues: which tables hang on which, and which public field lives in which column."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import types as T

from cellframe import fixed, schemas


class UnknownField(ValueError):
    """A request names a field that no table of the catalogue has."""


@dataclass(frozen=True)
class Dimension:
    """A table reached from ``parent.parent_key`` by its own ``key``; the tables may be listed in any depth order."""

    name: str
    key: str
    parent: str
    parent_key: str


@dataclass(frozen=True)
class Field:
    """One entry of the public vocabulary."""

    name: str
    table: str
    column: str
    kind: str = "categorical"
    description: str = ""


@dataclass(frozen=True)
class Selected:
    """A resolved projection column: where it comes from and what the result calls it."""

    table: str
    column: str
    output: str

    @property
    def path(self) -> str:
        return f"{self.table}.{self.column}"


@dataclass(frozen=True)
class StarCatalog:
    """A snowflake around one row per cell, a long table of values, and a feature table.

    ``required`` dimensions join inner even when cells are listed; ``bundle_dimensions`` are the inner
    dimensions of a bundle-list value selection.
    """

    root: str
    root_key: str
    dimensions: tuple[Dimension, ...]
    required: tuple[str, ...]
    bundle_dimensions: tuple[str, ...]
    values: str
    value_cell: str
    value_feature: str
    value_type: str
    value_column: str
    served_type: str
    features: str
    feature_key: str
    feature_name: str
    gene_flag: str
    feature_species: str
    fields: tuple[Field, ...]
    schemas: dict[str, T.StructType] = field(hash=False)
    default_fields: tuple[str, ...] = ()
    bundle_fields: tuple[str, ...] = ()
    bundle_column: str = ""
    barcode_column: str = ""
    species_field: str = ""
    species_fields: tuple[str, ...] = ()
    species: tuple[str, ...] = ()
    default_species: str = ""
    #: Partition column by which a cell and its values lie together, in tables that have it (see ``plans.store``).
    bucket: str = fixed.BUCKET

    @cached_property
    def by_name(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields}

    @cached_property
    def public_names(self) -> dict[str, str]:
        return {f.column: f.name for f in self.fields}

    @cached_property
    def dimension_by_name(self) -> dict[str, Dimension]:
        return {d.name: d for d in self.dimensions}

    def locate(self, name: str) -> tuple[str, str]:
        """Return (table, column) of a public name or of an internal ``table.column``."""
        known = self.by_name.get(name)
        if known:
            return known.table, known.column
        table, _, column = name.partition(".")
        if self._reachable(table) and column in self.schemas[table].fieldNames():
            return table, column
        raise UnknownField(name)

    def data_type(self, table: str, column: str) -> T.DataType:
        return self.schemas[table][column].dataType

    def select(self, names: Iterable[str]) -> list[Selected]:
        """Resolve a projection, expanding ``table.*`` and keeping the asked order."""
        found: list[tuple[str, str]] = []
        for name in names:
            table, _, rest = name.partition(".")
            if rest == "*" and self._reachable(table):
                found.extend((table, column) for column in self.schemas[table].fieldNames())
            else:
                found.append(self.locate(name))
        chosen, used = [], set()
        for table, column in dict.fromkeys(found):
            output = self.public_names.get(column, column)
            if output in used:
                output = f"{table}.{column}"
            used.add(output)
            chosen.append(Selected(table, column, output))
        return chosen

    def ancestors(self, tables: Iterable[str]) -> set[str]:
        """The given dimensions plus every dimension on their way to the root."""
        needed: set[str] = set()
        for name in tables:
            while name != self.root:
                needed.add(name)
                name = self.dimension_by_name[name].parent
        return needed

    def _reachable(self, table: str) -> bool:
        return table == self.root or table in self.dimension_by_name


def _describe(name: str, table: str, column: str) -> str:
    owner = table.replace("_", " ")
    if column.endswith("_label"):
        return f"Label of the {column.removesuffix('_label').replace('_', ' ')} term of the {owner}."
    if column.endswith("_ontology"):
        return f"Ontology term (prefix:accession) of the {column.removesuffix('_ontology').replace('_', ' ')} of the {owner}."
    if column.endswith("key"):
        return f"Identifier of the {owner}."
    return f"The {column.replace('_', ' ')} recorded for the {owner}."


CELL_CATALOG = StarCatalog(
    root="cell",
    root_key="cellkey",
    dimensions=(
        Dimension("analysis", "analysiskey", "cell", "analysiskey"),
        Dimension("cell_suspension", "cellsuspensionkey", "cell", "cellsuspensionkey"),
        Dimension("specimen", "specimenkey", "cell_suspension", "specimenkey"),
        Dimension("donor", "donorkey", "specimen", "donorkey"),
        Dimension("library_preparation", "librarykey", "cell", "librarykey"),
        Dimension("project", "projectkey", "cell", "projectkey"),
    ),
    required=("analysis",),
    bundle_dimensions=("analysis", "cell_suspension", "specimen", "donor"),
    values="expression",
    value_cell="cellkey",
    value_feature="featurekey",
    value_type="exprtype",
    value_column="exrpvalue",
    served_type=fixed.COUNT,
    features="feature",
    feature_key="featurekey",
    feature_name="featurename",
    gene_flag="isgene",
    feature_species="genus_species",
    fields=tuple(
        Field(n, t, c, "numeric" if n in fixed.NUMERIC_FIELDS else "categorical", _describe(n, t, c))
        for n, t, c in fixed.FIELDS
    ),
    schemas=schemas.WAREHOUSE,
    default_fields=fixed.DEFAULT_FIELDS,
    bundle_fields=fixed.BUNDLE_FIELDS,
    bundle_column="analysis.bundle_uuid",
    barcode_column="cell.barcode",
    species_field=fixed.SPECIES_FIELD,
    species_fields=fixed.SPECIES_FIELDS,
    species=fixed.SPECIES,
    default_species=fixed.HUMAN,
)
