"""Which bundles are taken in: assay or list, species, process type and schema versions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from cellframe import fixed


def version_gate(major: Column, minor: Column, bounds: tuple[int, int, int, int]) -> Column:
    """No major version, or (major, minor) within the bounds; without a minor the edge majors are refused."""
    low, low_minor, high, high_minor = bounds
    inside = (
        ((major == low) & (minor >= low_minor))
        | ((major == high) & (minor <= high_minor))
        | major.between(low + 1, high - 1)
    )
    return major.isNull() | F.coalesce(inside, F.lit(False))


def _gate(kind: str, bounds: tuple[int, int, int, int]) -> Column:
    """No document of the kind has a version, or one of them has an accepted one."""

    def accepted(v: Column) -> Column:
        return v["major"].isNotNull() & version_gate(v["major"], v["minor"], bounds)

    versioned = F.exists(kind, lambda v: v["major"].isNotNull())
    return F.coalesce(~versioned | F.exists(kind, accepted), F.lit(True))


def all_gates(summary: DataFrame, versions: dict[str, tuple[int, int, int, int]] = fixed.SCHEMA_VERSIONS) -> Column:
    """Every entity kind of the summary passes; a kind is a column of ``(major, minor)`` pairs, null without documents."""
    tests = [_gate(kind, bounds) for kind, bounds in versions.items() if kind in summary.columns]
    return reduce(and_, tests) if tests else F.lit(True)


def _any(array: Column, *values: object) -> Column:
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, values))), F.lit(False))


def select_bundles(
    summary: DataFrame, projects: list[str] | None = None, bundles: DataFrame | None = None
) -> DataFrame:
    """Bundles to load.

    ``summary`` has one row per bundle: ``bundle_fqid``, ``project_ids``, ``method_ontologies``,
    ``method_labels``, ``taxa``, ``process_types`` (arrays), and per entity kind an array of versions.
    Without projects or bundles the served assays are taken.
    """
    if projects or bundles is not None:
        asked = _any(F.col("project_ids"), *projects) if projects else F.lit(False)
        if bundles is not None:
            listed = bundles.select(F.col(bundles.columns[0]).alias("bundle_fqid"), F.lit(True).alias("listed"))
            summary = summary.join(listed.distinct(), "bundle_fqid", "left")
            asked = asked | F.coalesce("listed", F.lit(False))
    else:
        asked = _any(F.col("method_ontologies"), fixed.LIBRARY_METHOD_ONTOLOGY) | _any(
            F.col("method_labels"), fixed.LIBRARY_METHOD_LABEL
        )
    return summary.filter(
        asked
        & _any(F.col("taxa"), *fixed.TAXA)
        & _any(F.col("process_types"), fixed.ANALYSIS_PROCESS)
        & all_gates(summary)
    ).select("bundle_fqid")
