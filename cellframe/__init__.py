"""Sparse entity-by-feature matrices on Spark: ingest, select, describe, reshape, export, maintain."""

from cellframe.catalog import CELL_CATALOG, StarCatalog
from cellframe.functions.predicates import MalformedFilter, to_column
from cellframe.plans.describe import describe_all, describe_field, list_fields
from cellframe.plans.ingest import ingest_bundles
from cellframe.plans.request import MatrixRequest, bundle_request, fan_out
from cellframe.sinks.matrix import MatrixExport

__all__ = [
    "CELL_CATALOG",
    "MalformedFilter",
    "MatrixExport",
    "MatrixRequest",
    "StarCatalog",
    "bundle_request",
    "describe_all",
    "describe_field",
    "fan_out",
    "ingest_bundles",
    "list_fields",
    "to_column",
]
