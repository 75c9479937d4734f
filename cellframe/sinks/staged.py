"""Staged rows and stored results as ``|``-separated parts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F, types as T

from cellframe.functions.text import short_boolean
from cellframe.schemas import RESULT_MANIFEST


def as_text(frame: DataFrame) -> DataFrame:
    """Every column as staged text: booleans ``t``/``f``, missing values empty."""
    return frame.select(
        *(
            short_boolean(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.BooleanType)
            else F.col(f"`{f.name}`").cast("string").alias(f.name)
            for f in frame.schema.fields
        )
    )


def append_staged(frame: DataFrame, path: str, compression: str = "none") -> None:
    """Append rows to a staged table; empty text is quoted, so that it is told from a missing value."""
    as_text(frame).write.mode("append").option("sep", "|").option("compression", compression).csv(path)


def write_per_bundle(frame: DataFrame, path: str) -> None:
    """Gzip parts in one folder per ``bundle_fqid``; a large bundle is spread over several parts."""
    order = ["bundle_fqid", *(c for c in frame.columns if c != "bundle_fqid")]
    as_text(frame).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("bundle_fqid").option("sep", "|").option("emptyValue", "").option(
        "compression", "gzip"
    ).csv(path)


def store_result(frame: DataFrame, path: str) -> DataFrame:
    """Store a result as gzip parts under ``parts``, and under ``manifest`` their places, record counts and columns.

    ``sources.results`` reads it back. Returns the manifest, one row per part: ``(url, record_count)``. A record is what
    the reader takes for one, so a line break inside a field doesn't count twice.
    """
    parts = os.path.join(path, "parts")
    as_text(frame).write.option("sep", "|").option("emptyValue", "").option("compression", "gzip").csv(parts)
    spark = frame.sparkSession
    text = T.StructType([T.StructField(name, T.StringType()) for name in frame.columns])
    rows = spark.read.schema(text).option("sep", "|").option("multiLine", True).csv(parts)
    counted = rows.groupBy(F.col("_metadata.file_path").alias("url")).agg(F.count(F.lit(1)).alias("record_count"))
    # One entry per part: as many as the result has files.
    meta = F.struct(F.lit(None).cast("long").alias("content_length"), F.col("record_count"))
    entries = F.array_sort(F.collect_list(F.struct("url", meta.alias("meta"))))
    names = F.array(*(F.struct(F.lit(name).alias("name")) for name in frame.columns))
    total = F.coalesce(F.sum("record_count"), F.lit(0))
    manifest = counted.agg(
        entries.alias("entries"),
        F.struct(names.alias("elements")).alias("schema"),
        F.struct(F.lit(None).cast("long").alias("content_length"), total.alias("record_count")).alias("meta"),
    )
    manifest.write.json(os.path.join(path, "manifest"))
    stored = spark.read.schema(RESULT_MANIFEST).json(os.path.join(path, "manifest"))
    return stored.select(F.inline("entries")).select("url", F.col("meta.record_count").alias("record_count"))
