"""Result sets of an earlier system: a JSON manifest and ``|``-separated parts without header."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cellframe.catalog import CELL_CATALOG, StarCatalog
from cellframe.fixed import EXPRESSION_BLOCK
from cellframe.operators.prefix import whole_blocks
from cellframe.schemas import EXPRESSION_RESULT, RESULT_MANIFEST, WAREHOUSE


class ResultsNotFound(ValueError):
    """There is no manifest at the given place."""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(columns, part_urls, record_count)``; parts without rows are left out."""
    frame = spark.read.schema(RESULT_MANIFEST).option("multiLine", True).json(path)
    filled = F.filter("entries", lambda e: F.coalesce(e["meta"]["record_count"], F.lit(0)) > 0)
    return frame.select(
        F.col("schema.elements.name").alias("columns"),
        F.transform(filled, lambda e: e["url"]).alias("part_urls"),
        F.col("meta.record_count").alias("record_count"),
    )


def _parts(spark: SparkSession, manifest: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    row = manifest.first()
    if row is None:
        raise ResultsNotFound("empty manifest")
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in row["columns"]])
    if not row["part_urls"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("sep", "|").option("multiLine", True).csv(list(row["part_urls"]))


def public_names(frame: DataFrame, catalog: StarCatalog = CELL_CATALOG) -> DataFrame:
    """Columns under their public field names; others keep theirs."""
    return frame.withColumnsRenamed({c: catalog.public_names[c] for c in frame.columns if c in catalog.public_names})


def read_cell_result(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Cell metadata keyed by ``cellkey``: integer genes, numeric molecules, text for the rest."""
    types = {"genes_detected": T.LongType(), "total_umis": T.DoubleType()}
    return public_names(_parts(spark, manifest, types))


def read_feature_result(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Feature metadata keyed by ``featurekey``; ``t`` and ``f`` are booleans."""
    types = {f.name: f.dataType for f in WAREHOUSE["feature"].fields} | {"isgene": T.StringType()}
    frame = _parts(spark, manifest, types)
    flag = F.lower("isgene")
    return frame.withColumn("isgene", F.when(flag.isin("t", "true"), True).when(flag.isin("f", "false"), False))


def read_expression_result(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(cellkey, featurekey, exprvalue)``, whatever the parts call the third column."""
    row = manifest.first()
    if row is None or not row["part_urls"]:
        return spark.createDataFrame([], EXPRESSION_RESULT)
    return spark.read.schema(EXPRESSION_RESULT).option("sep", "|").option("multiLine", True).csv(list(row["part_urls"]))


def result_blocks(values: DataFrame, rows: int = EXPRESSION_BLOCK, cell: str = "cellkey") -> DataFrame:
    """``values`` with ``block``, which keeps a cell's values together in at most ``rows`` rows (see ``operators.prefix``).

    A reader takes block after block: all of a cell is in one, and a cell with more values is a block by itself.
    """
    blocks = whole_blocks(values, rows, cell).select(F.col(cell).alias("cell!"), "block")
    return values.join(blocks, F.col(cell).eqNullSafe(F.col("cell!"))).drop("cell!")


def write_blocks(values: DataFrame, path: str, rows: int = EXPRESSION_BLOCK, cell: str = "cellkey") -> None:
    """Write ``values`` with one folder ``block=n`` for each block; a block lies whole in one file, in order of cells."""
    dealt = result_blocks(values, rows, cell).repartition("block").sortWithinPartitions("block", cell)
    dealt.write.partitionBy("block").parquet(path)


# Stands for a missing value while staged rows are read: were it the empty text, quoted empty text would be missing too.
_NOTHING = "\x01"


def read_staged(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Staged ``|``-separated rows of a warehouse table, plain or gzip: quoted empty text is empty, nothing between two
    separators is null, line ends may stand within quotes, ``t`` and ``f`` are booleans.
    """
    schema = WAREHOUSE[table]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    frame = spark.read.schema(text).option("sep", "|").option("multiLine", True).option("nullValue", _NOTHING).csv(path)
    return frame.select(*(_typed(f) for f in schema.fields))


def _typed(field: T.StructField):
    column = F.col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        flag = F.lower(column)
        return F.when(flag.isin("t", "true"), True).when(flag.isin("f", "false"), False).alias(field.name)
    return column.cast(field.dataType).alias(field.name)


def read_bundle_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct first-column values of a tab-separated file with a header."""
    frame = spark.read.option("header", True).option("sep", "\t").csv(path)
    return frame.select(F.col(f"`{frame.columns[0]}`").alias("bundle")).filter("bundle IS NOT NULL").distinct()
