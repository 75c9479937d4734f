"""Feature annotation text, one file or folder per species."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellframe.functions.annotation import column, own_attribute
from cellframe.functions.identifiers import feature_id
from cellframe.operators.keyed import concat


def read_annotation(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``(line, genus_species)`` without comment lines; ``paths`` maps a species to its file."""
    return concat(
        *(
            spark.read.text(path)
            .filter(~F.col("value").startswith("#"))
            .select(F.col("value").alias("line"), F.lit(species).alias("genus_species"))
            for species, path in paths.items()
        )
    )


def features(lines: DataFrame) -> DataFrame:
    """The feature table: gene and transcript records, duplicates dropped."""
    line, attributes, record = F.col("line"), F.col("attributes"), F.col("record")
    return (
        lines.select(
            "genus_species",
            "line",
            column(line, 2).alias("record"),
            column(line, 8).alias("attributes"),
        )
        .filter(record.isin("gene", "transcript"))
        .select(
            feature_id(own_attribute(attributes, record, "id")).alias("featurekey"),
            own_attribute(attributes, record, "name").alias("featurename"),
            own_attribute(attributes, record, "type").alias("featuretype"),
            column(line, 0).alias("chromosome"),
            column(line, 3).cast("int").alias("featurestart"),
            column(line, 4).cast("int").alias("featureend"),
            (record == "gene").alias("isgene"),
            "genus_species",
        )
        .distinct()
    )
