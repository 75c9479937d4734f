"""Matrix metrics: sum, non-zero entries and cells, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def matrix_metrics(values: DataFrame, cell: str = "cellkey", value: str = "exprvalue") -> DataFrame:
    """One row ``(total, nonzero, cells)``."""
    per_cell = values.groupBy(cell).agg(
        F.sum(F.col(value).cast("double")).alias("total"), F.count_if(F.col(value) != 0).alias("nonzero")
    )
    return per_cell.agg(
        F.sum("total").alias("total"),
        F.coalesce(F.sum("nonzero"), F.lit(0)).cast("long").alias("nonzero"),
        F.count(F.lit(1)).alias("cells"),
    )


def metrics_agree(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> bool:
    """Do two matrices have the same metrics, up to the relative tolerance?"""
    a, b = left.first(), right.first()
    return all(
        abs((a[n] or 0) - (b[n] or 0)) <= tolerance * max(abs(a[n] or 0), abs(b[n] or 0))
        for n in ("total", "nonzero", "cells")
    )
