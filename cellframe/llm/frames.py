"""Small helpers shared by the operators: tables, raw byte files, running totals."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from cellframe.session import scratch_dir

#: Words of every contract: runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns of these very names, whatever characters they have."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def write_blobs(rows: DataFrame, path: str, end: str = "\n") -> None:
    """Write each row's ``data`` (binary) as a file of its own, followed by ``end``.

    Spark's text writer takes the bytes as they are, so the files can lie in any store that Spark writes.
    """
    data = rows.select(F.col("data").cast("string").alias("value"))
    data.write.option("lineSep", end).option("maxRecordsPerFile", 1).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files' bytes (``content``), one row per file."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("content")


def running_total(totals: DataFrame, by: Sequence[str], order: str, value: str, into: str, span: int = 4096) -> DataFrame:
    """``totals`` with the sum of ``value`` over all rows of ``by`` with a smaller ``order`` (a whole number).

    Rows are summed in spans of ``order`` first, so that one task sees one row per span.
    """
    spanned = totals.withColumn("span!", F.floor(F.col(order) / span))
    per_span = spanned.groupBy(*by, "span!").agg(F.sum(value).alias("span_total!"))
    w = Window.partitionBy(*by).orderBy("span!") if by else Window.orderBy("span!")
    before = per_span.withColumn("before!", F.coalesce(F.sum("span_total!").over(w.rowsBetween(*_upto())), F.lit(0)))
    inside = Window.partitionBy(*by, "span!").orderBy(order).rowsBetween(*_upto())
    keys = [*by, "span!"]
    right = before.select(*(F.col(k).alias(f"{k}?") for k in keys), "before!")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}?"))
    return (
        spanned.withColumn("inside!", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(right, same)
        .withColumn(into, (F.col("inside!") + F.col("before!")).cast("long"))
        .drop("inside!", "before!", "span!", *(f"{k}?" for k in keys))
    )


def _upto() -> tuple[int, int]:
    return Window.unboundedPreceding, -1


def annotated(
    docs: DataFrame,
    text: str,
    columns: str,
    describe: Callable[[list[str | None]], Mapping[str, Sequence]],
    keep: Sequence[str] | None = None,
    only: str | None = None,
    rows_at_once: int = 512,
) -> DataFrame:
    """``docs`` with ``columns`` (DDL) that ``describe`` makes from a list of texts, in one pass and without a shuffle.

    ``keep`` names the columns of ``docs`` to hand on, all by default; those with a name among ``columns`` are
    replaced. With ``only``, rows go whose value in that boolean column is false.
    """
    made = StructType.fromDDL(columns)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made.names]
    rows = docs.select(*quoted(kept), F.col(text).alias("text!"))
    schema = StructType([*rows.schema.fields[: len(kept)], *made.fields])
    plain = rows.toDF(*(f"c{i}" for i in range(len(kept) + 1)))  # mapInArrow looks columns up by name, dots and all
    types = [to_arrow_type(f.dataType) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                found = describe(batch.column(len(kept)).to_pylist())
                arrays = [*batch.columns[: len(kept)], *(pa.array(found[n], t) for n, t in zip(made.names, types))]
                out = pa.RecordBatch.from_arrays(arrays, names=[*kept, *made.names])
                yield out.filter(out.column(out.schema.get_field_index(only))) if only else out

    return plain.mapInArrow(run, schema)
