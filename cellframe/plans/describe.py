"""Field descriptions: how many cells fall in each category, and the range of numeric fields."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cellframe.catalog import Field, StarCatalog, UnknownField
from cellframe.operators.keyed import concat
from cellframe.operators.star import Tables, left_chain


# Cells that a row stands for.
_CELLS = "cells!"


def category(column: Column, data_type: T.DataType) -> Column:
    """Category text: ``True``/``False`` for booleans, empty for missing."""
    text = column.cast("string")
    if isinstance(data_type, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit(""))


def list_fields(spark: SparkSession, catalog: StarCatalog) -> DataFrame:
    """The vocabulary: ``(field, table, column, kind, description)``."""
    return spark.createDataFrame(
        [(f.name, f.table, f.column, f.kind, f.description) for f in catalog.fields],
        "field string, table string, column string, kind string, description string",
    )


def _field(catalog: StarCatalog, name: str) -> Field:
    try:
        return catalog.by_name[name]
    except KeyError:
        raise UnknownField(name) from None


def describe_field(catalog: StarCatalog, tables: Tables, name: str) -> DataFrame:
    """``(field, kind, value, cells, minimum, maximum)`` of one field."""
    field = _field(catalog, name)
    return _description(_path_chain(catalog, tables, {field.table}), catalog, [field])


def describe_all(catalog: StarCatalog, tables: Tables, unique_dimensions: Collection[str] = ()) -> DataFrame:
    """Every field at once.

    Fields that are reached through dimensions with unique keys (see ``plans.audits.duplicate_keys``) are counted
    together: cells are first counted per combination of dimension keys, so that only these combinations meet the
    dimensions and give a row per field. A dimension with repeated keys would multiply the cells of all fields of that
    pass, so the others are counted table by table.
    """
    shared, rest = _shared(catalog, unique_dimensions)
    own = [f for f in shared if f.table == catalog.root]
    others = [f for f in shared if f.table != catalog.root]
    parts = [_description(tables[catalog.root].alias(catalog.root), catalog, own)] if own else []
    if others:
        reached = catalog.ancestors({f.table for f in others})
        keys = dict.fromkeys(d.parent_key for d in catalog.dimensions if d.name in reached and d.parent == catalog.root)
        counted = tables[catalog.root].groupBy(*keys).agg(F.count(F.lit(1)).alias(_CELLS))
        chain = _path_chain(catalog, {**tables, catalog.root: counted}, {f.table for f in others})
        parts.append(_description(chain, catalog, others, F.col(f"{catalog.root}.`{_CELLS}`")))
    parts += [_description(_path_chain(catalog, tables, {fields[0].table}), catalog, fields) for fields in rest]
    return concat(*parts)


def field_coverage(catalog: StarCatalog, tables: Tables, unique_dimensions: Collection[str] = ()) -> DataFrame:
    """``(field, kind, cells)``: how many cells have a value of each field."""
    return concat(
        *(_coverage(chain, fields) for chain, fields in _passes(catalog, tables, unique_dimensions))
    )


def _path_chain(catalog: StarCatalog, tables: Tables, owners: Collection[str]) -> DataFrame:
    """Every cell, left-joined with the dimensions on the way to the owners and no others."""
    return left_chain(replace(catalog, required=()), tables, catalog.ancestors(owners))


def _shared(catalog: StarCatalog, unique_dimensions: Collection[str]) -> tuple[list[Field], list[list[Field]]]:
    """Fields that one pass can count, and the others by table."""
    shared = [f for f in catalog.fields if catalog.ancestors([f.table]) <= set(unique_dimensions)]
    owners = dict.fromkeys(f.table for f in catalog.fields if f not in shared)
    return shared, [[f for f in catalog.fields if f.table == owner] for owner in owners]


def _passes(
    catalog: StarCatalog, tables: Tables, unique_dimensions: Collection[str]
) -> Iterator[tuple[DataFrame, list[Field]]]:
    shared, rest = _shared(catalog, unique_dimensions)
    for fields in ([shared] if shared else []) + rest:
        yield _path_chain(catalog, tables, {f.table for f in fields}), fields


def _coverage(chain: DataFrame, fields: list[Field]) -> DataFrame:
    counts = chain.agg(*(F.count(f"{f.table}.{f.column}").alias(f"n{i}") for i, f in enumerate(fields)))
    rows = F.array(
        *(
            F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), F.col(f"n{i}").alias("cells"))
            for i, f in enumerate(fields)
        )
    )
    return counts.select(F.inline(rows))


def _description(chain: DataFrame, catalog: StarCatalog, fields: list[Field], cells: Column | None = None) -> DataFrame:
    """Categories with their cells, and ranges of numbers; a row of ``chain`` stands for ``cells`` cells, one by default.

    A row gives one for each categorical field, which each task reduces to its categories before anything is shuffled.
    Numbers are reduced to their ends where they are, and are described where there are no cells, too.
    """

    def entry(f: Field) -> Column:
        value = category(F.col(f"{f.table}.{f.column}"), catalog.data_type(f.table, f.column))
        return F.struct(F.lit(f.name).alias("field"), value.alias("value"))

    def ends(f: Field, i: int) -> Column:
        return F.struct(F.lit(f.name).alias("field"), F.col(f"low{i}").alias("minimum"), F.col(f"high{i}").alias("maximum"))

    of_kind = lambda kind: [f for f in fields if f.kind == kind]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    parts = []
    if categorical := of_kind("categorical"):
        rows = chain.select((F.lit(1) if cells is None else cells).alias("n"), F.inline(F.array(*map(entry, categorical))))
        counted = rows.groupBy("field", "value").agg(F.sum("n").alias("cells"))
        parts.append(counted.select("field", F.lit("categorical").alias("kind"), "value", "cells", none("double", "minimum"), none("double", "maximum")))
    if numeric := of_kind("numeric"):
        numbers = [F.col(f"{f.table}.{f.column}").cast("double") for f in numeric]
        range_ = chain.agg(*(F.min(c).alias(f"low{i}") for i, c in enumerate(numbers)), *(F.max(c).alias(f"high{i}") for i, c in enumerate(numbers)))
        rows = range_.select(F.inline(F.array(*(ends(f, i) for i, f in enumerate(numeric)))))
        parts.append(rows.select("field", F.lit("numeric").alias("kind"), none("string", "value"), none("long", "cells"), "minimum", "maximum"))
    if not parts:
        raise ValueError("no field that can be described")
    return concat(*parts)
