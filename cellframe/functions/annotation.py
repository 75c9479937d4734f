"""Annotation lines: tab-separated columns whose last one holds ``key "value";`` pairs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def column(line: Column, position: int) -> Column:
    """Column ``position`` (0-based) of a tab-separated line, null when the line is shorter."""
    return F.get(F.split(F.rtrim(line), "\t"), F.lit(position))


def attribute(attributes: Column, name: str) -> Column:
    """Value of one attribute, empty when absent."""
    return F.regexp_extract(attributes, rf'(?:^|;)\s*{name} "([^"]*)"', 1)


def own_attribute(attributes: Column, record: Column, suffix: str) -> Column:
    """``gene_<suffix>`` of a gene record, ``transcript_<suffix>`` of a transcript record."""
    return F.when(record == "gene", attribute(attributes, f"gene_{suffix}")).otherwise(
        attribute(attributes, f"transcript_{suffix}")
    )
