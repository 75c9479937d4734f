"""The filter language: nested dictionaries of comparisons and and/or/not, turned into one Column."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from cellframe import fixed
from cellframe.catalog import StarCatalog, UnknownField


class MalformedFilter(ValueError):
    """The filter breaks a rule of the filter language."""


class MalformedFeature(ValueError):
    """The feature kind is not one that is served."""


class _Unfit(Exception):
    """A literal cannot be read as the type of its column."""


_COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}
_TRUE_TEXT = ("true", "t", "1")
_FALSE_TEXT = ("false", "f", "0")


def to_column(filter_: Mapping[str, Any], catalog: StarCatalog) -> Column:
    """Validate ``filter_`` and return the predicate over a chain of the catalogue's aliased tables."""
    op, value = _part(filter_, "op"), _part(filter_, "value")
    if op in fixed.COMPARISONS:
        return _comparison(op, _part(filter_, "field"), value, catalog)
    if op in fixed.LOGICALS:
        children = [to_column(child, catalog) for child in _children(op, value)]
        if op == "not":
            return ~children[0]
        return reduce(operator.and_ if op == "and" else operator.or_, children)
    raise MalformedFilter(f"{op!r} is neither a comparison ({', '.join(fixed.COMPARISONS)}) nor one of {', '.join(fixed.LOGICALS)}")


def fields_of(filter_: Mapping[str, Any]) -> set[str]:
    """Every field name the filter mentions."""
    op, value = _part(filter_, "op"), _part(filter_, "value")
    if op in fixed.LOGICALS:
        return set().union(*(fields_of(child) for child in _children(op, value)))
    return {_part(filter_, "field")}


def mentions_species(filter_: Mapping[str, Any], catalog: StarCatalog) -> bool:
    """Does the filter constrain the species anywhere, also under ``not``?"""
    return not fields_of(filter_).isdisjoint(catalog.species_fields)


def feature_kind(feature: str, catalog: StarCatalog) -> Column:
    """Genes or transcripts of the feature table."""
    flag = F.col(f"{catalog.features}.{catalog.gene_flag}")
    if feature == "gene":
        return flag
    if feature == "transcript":
        return ~flag
    raise MalformedFeature(f"{feature!r} is not served; ask for 'gene' or 'transcript'")


def _part(filter_: Mapping[str, Any], name: str) -> Any:
    if not isinstance(filter_, Mapping) or name not in filter_:
        raise MalformedFilter(f"each node of a filter needs {name!r}, and {filter_!r} has none")
    return filter_[name]


def _children(op: str, value: Any) -> list[Mapping[str, Any]]:
    if op == "not" and isinstance(value, Mapping):
        return [value]
    if not isinstance(value, (list, tuple)):
        raise MalformedFilter(f"{op!r} combines a list of filters, not {value!r}")
    if op == "not" and len(value) != 1:
        raise MalformedFilter(f"'not' turns around exactly one filter, here there are {len(value)}")
    if op != "not" and len(value) < 2:
        raise MalformedFilter(f"{op!r} needs two filters or more to combine, here it has {len(value)}")
    return list(value)


def _comparison(op: str, name: str, value: Any, catalog: StarCatalog) -> Column:
    if op == "in" and not isinstance(value, (list, tuple)):
        raise MalformedFilter(f"'in' on {name} looks through a list of values, not {value!r}")
    try:
        table, name = catalog.locate(name)
    except UnknownField as unknown:
        raise MalformedFilter(f"no field of the catalogue is called {name!r}") from unknown
    column, data_type = F.col(f"{table}.{name}"), catalog.data_type(table, name)
    if op == "in":
        fitting = [lit for lit in (_literal_or_none(v, data_type) for v in value) if lit is not None]
        return column.isin(fitting) if fitting else _unless_null(column, False)
    try:
        return _COMPARE[op](column, F.lit(_literal(value, data_type)))
    except _Unfit:
        if op in ("=", "!="):
            return _unless_null(column, op == "!=")
        raise MalformedFilter(f"{value!r} cannot be ordered against {name}") from None


def _unless_null(column: Column, answer: bool) -> Column:
    return F.when(column.isNotNull(), F.lit(answer))


def _literal_or_none(value: Any, data_type: T.DataType) -> Any:
    try:
        return _literal(value, data_type)
    except _Unfit:
        return None


def _literal(value: Any, data_type: T.DataType) -> Any:
    """Read a request literal as the type of the column it is compared with."""
    if value is None or isinstance(value, (Mapping, list, tuple)):
        raise MalformedFilter(f"{value!r} is not a string or a number")
    if isinstance(data_type, T.StringType):
        return str(value)
    text = str(value).strip().lower()
    if isinstance(data_type, T.BooleanType):
        if text in _TRUE_TEXT:
            return True
        if text in _FALSE_TEXT:
            return False
        raise _Unfit
    if isinstance(data_type, T.NumericType):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return value
        for read in (int, float):
            try:
                return read(text)
            except ValueError:
                continue
        raise _Unfit
    return value
