"""Bundle directories: ``<uuid>.<version>/<kind>_<n>.json`` documents, manifests and count files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cellframe.schemas import DOCUMENTS, MANIFEST
from cellframe.session import build_side, durable, together

CORRUPT = "_corrupt_record"
_PATTERN = re.compile(r"[{}\[\]*?\\,]")


def bundle_name(path: Column) -> Column:
    """Name of the directory a file lies in; paths of files come with special characters encoded."""
    return F.url_decode(F.replace(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))


def document_number(path: Column) -> Column:
    """The number in ``<kind>_<n>.json``."""
    return F.regexp_extract(path, r"_(\d+)\.json$", 1).try_cast("int")


def bundle_paths(spark: SparkSession, root: str, only: Collection[str] | None = None) -> list[str]:
    """The landing zone, or the exact paths of those of the named bundle directories that have arrived.

    A name is one directory below the landing zone; the characters that patterns use are taken as they are.
    """
    if only is None:
        return [root]
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [name for name in sorted(set(only)) if name and "/" not in name and name not in (".", "..")]
    there = [name for name in names if files.exists(hadoop.Path(os.path.join(root, name)))]
    return [os.path.join(root, _PATTERN.sub(r"\\\g<0>", name)) for name in there]


def _or_empty(read: Callable[[], DataFrame], spark: SparkSession, schema: str, paths: Sequence[str]) -> DataFrame:
    """What ``read`` gives, or no rows when there are no paths or nothing lies there."""
    try:
        return read() if paths else spark.createDataFrame([], schema)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def read_texts(spark: SparkSession, path: list[str], pattern: str = "*.json") -> DataFrame:
    """``(bundle_fqid, kind, ordinal, value)``: every file named by ``pattern`` below the path as one text."""

    def read() -> DataFrame:
        file = F.col("_metadata.file_path")
        return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(
            bundle_name(file).alias("bundle_fqid"),
            F.regexp_extract(file, r"([^/]+?)(?:_\d+)?\.json$", 1).alias("kind"),
            document_number(file).alias("ordinal"),
            "value",
        )

    return _or_empty(read, spark, "bundle_fqid string, kind string, ordinal int, value string", path)


def parse(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """Texts as documents; an unreadable one keeps its text in ``_corrupt_record``."""
    document = F.from_json(
        "value",
        T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]),
        {"columnNameOfCorruptRecord": CORRUPT},
    )
    return texts.select("bundle_fqid", "ordinal", document.alias("document")).select(
        "bundle_fqid", "ordinal", "document.*"
    )


def manifest_file(files: Column, suffix: str) -> Column:
    """The first manifest entry whose name ends with ``suffix``; null when there is none."""
    return F.get(F.filter(files, lambda f: f["name"].endswith(suffix)), F.lit(0))


def _titled(texts: DataFrame, separator: str) -> DataFrame:
    """``(bundle_fqid, titles, fields)``: every line of every text but its first one, which gives the titles.

    A text is a whole file, so that its own title line says which field is which, whatever other files say. One without
    lines below its titles gives a row without fields.
    """
    lines = F.filter(F.split("value", r"\r\n|\r|\n"), lambda line: F.trim(line) != "")
    named = texts.select("bundle_fqid", lines.alias("lines"))
    cut = lambda line: F.transform(F.split(line, separator), lambda f: F.trim(F.regexp_replace(f, '^"|"$', "")))
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    # Titles are cut once for a file, not for each of its lines.
    found = named.select("bundle_fqid", cut(F.get("lines", F.lit(0))).alias("titles"), body.alias("body"))
    found = found.select("bundle_fqid", "titles", F.explode_outer("body").alias("line"))
    return found.select("bundle_fqid", "titles", cut(F.col("line")).alias("fields"))


_TEXTS = "bundle_fqid string, value string"


def _files(spark: SparkSession, path: list[str], pattern: str) -> DataFrame:
    """``(bundle_fqid, value)`` of every file named by ``pattern``."""

    def read() -> DataFrame:
        whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        return whole.select(bundle_name(F.col("_metadata.file_path")).alias("bundle_fqid"), "value")

    return _or_empty(read, spark, _TEXTS, path)


def _named(title: str) -> Column:
    """The field under a title; null where the file has no such title."""
    return F.get("fields", F.array_position("titles", F.lit(title)).cast("int") - 1)


def read_counts(spark: SparkSession, path: list[str], kind: str) -> DataFrame:
    """``(bundle_fqid, id, tpm, expected_count)`` of the ``*.genes.results`` or ``*.isoforms.results`` files.

    Columns are found by the title line of each file. A file that lacks one of them gives rows that lack its values,
    so that intake sets its bundle aside; so does a file without rows, with one row that lacks all.
    """
    return counts_of(_files(spark, path, f"*.{kind}.results"), kind)


def counts_of(texts: DataFrame, kind: str) -> DataFrame:
    """What :func:`read_counts` gives, of files as texts (``bundle_fqid``, ``value``)."""
    key = {"genes": "gene_id", "isoforms": "transcript_id"}[kind]
    return _titled(texts, "\t").select(
        "bundle_fqid",
        _named(key).alias("id"),
        _named("TPM").try_cast("double").alias("tpm"),
        _named("expected_count").try_cast("double").alias("expected_count"),
    )


def read_calls(spark: SparkSession, path: list[str]) -> DataFrame:
    """``(bundle_fqid, cell_id, total, is_cell)`` of the empty-droplet calls, columns found by each file's title line.

    What is no number or neither TRUE nor FALSE is null.
    """
    return calls_of(_files(spark, path, CALLS))


CALLS = "empty_drops_result.csv"


def calls_of(texts: DataFrame) -> DataFrame:
    """What :func:`read_calls` gives, of files as texts (``bundle_fqid``, ``value``)."""
    call = F.upper(_named("IsCell"))
    return _titled(texts, ",").select(
        "bundle_fqid",
        _named("CellId").alias("cell_id"),
        _named("Total").try_cast("int").alias("total"),
        F.when(call.isin("TRUE", "FALSE"), call == "TRUE").alias("is_cell"),
    )


@dataclass(frozen=True)
class Landing:
    """Everything that has arrived for a set of bundles.

    ``chunks`` holds dense rows ``(bundle_fqid, cell_id, values)``, ``axis`` the gene of each position
    ``(bundle_fqid, gene_ids)``.
    """

    documents: Mapping[str, DataFrame]
    manifests: DataFrame
    genes: DataFrame
    isoforms: DataFrame
    calls: DataFrame
    chunks: DataFrame
    axis: DataFrame

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Landing:
        """Every frame changed in the same way."""
        return Landing(
            {kind: change(frame) for kind, frame in self.documents.items()},
            *(change(f) for f in (self.manifests, self.genes, self.isoforms, self.calls, self.chunks, self.axis)),
        )

    def restrict(self, bundles: DataFrame) -> Landing:
        """Only the given bundles. What lies outside their range of names is left out before any row is moved."""
        wanted = build_side(bundles.select("bundle_fqid").distinct())
        low, high = bundles.agg(F.min("bundle_fqid"), F.max("bundle_fqid")).first()
        within = F.lit(False) if low is None else F.col("bundle_fqid").between(F.lit(low), F.lit(high))
        return self.each(lambda frame: frame.filter(within).join(wanted, "bundle_fqid", "left_semi"))

    def kept(self) -> Landing:
        """The same rows, written once, so that what reads them many times neither parses nor selects them again."""
        parts = {**self.documents, **{name: getattr(self, name) for name in _PARTS}}
        spark = self.manifests.sparkSession
        written = together(spark, [lambda n=name, f=frame: durable(f, f"kept-{n}") for name, frame in parts.items()], threads=3)
        found = dict(zip(parts, written))
        return Landing({kind: found[kind] for kind in self.documents}, *(found[name] for name in _PARTS))

    def without(self, bundles: DataFrame) -> Landing:
        """All but the given bundles."""
        unwanted = build_side(bundles)
        return self.each(lambda frame: frame.join(unwanted, "bundle_fqid", "left_anti"))


CHUNKS = "bundle_fqid string, cell_id string, values array<float>"
AXIS = "bundle_fqid string, gene_ids array<string>"
_PARTS = ("manifests", "genes", "isoforms", "calls", "chunks", "axis")


def read_bundles(spark: SparkSession, root: str, only: Collection[str] | None = None) -> Landing:
    """Read bundle directories as they are: all of them, or only the named ones that have arrived.

    Dense rows lie in ``chunks*.parquet`` and ``axis*.parquet``, file lists in ``manifest.json``. Every use of a
    kind parses its files again; :func:`compact` a large landing zone first.
    """
    path = bundle_paths(spark, root, only)
    return Landing(
        documents={
            kind: parse(read_texts(spark, path, f"{kind}_[0-9]*.json"), schema) for kind, schema in DOCUMENTS.items()
        },
        manifests=parse(read_texts(spark, path, "manifest.json"), MANIFEST),
        **_count_files(spark, path),
    )


def _count_files(spark: SparkSession, path: list[str]) -> dict[str, DataFrame]:
    return {
        "genes": read_counts(spark, path, "genes"),
        "isoforms": read_counts(spark, path, "isoforms"),
        "calls": read_calls(spark, path),
        "chunks": _dense(spark, path, "chunks*.parquet", CHUNKS),
        "axis": _dense(spark, path, "axis*.parquet", AXIS),
    }


def _dense(spark: SparkSession, path: list[str], pattern: str, schema: str) -> DataFrame:
    def read() -> DataFrame:
        return (
            spark.read.schema(schema)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .parquet(*path)
        )

    return _or_empty(read, spark, schema, path)


def compact(spark: SparkSession, root: str, out: str) -> None:
    """Write a landing zone of many small files as one Parquet table per kind.

    All JSON files are listed and read once, then split by kind.
    """
    texts = durable(read_texts(spark, [root]), "texts")
    tables = {
        f"documents/{kind}": parse(texts.filter(F.col("kind") == kind), schema) for kind, schema in DOCUMENTS.items()
    }
    tables["manifests"] = parse(texts.filter("kind = 'manifest'"), MANIFEST)
    tables |= _count_files(spark, [root])
    together(
        spark,
        [lambda n=name, f=frame: f.write.mode("overwrite").parquet(os.path.join(out, n)) for name, frame in tables.items()],
    )


def read_compacted(spark: SparkSession, out: str) -> Landing:
    """Read what :func:`compact` wrote."""
    return Landing(
        {kind: spark.read.parquet(os.path.join(out, "documents", kind)) for kind in DOCUMENTS},
        *(spark.read.parquet(os.path.join(out, part)) for part in _PARTS),
    )


# Kinds of count files in a landing table, and what their names end with.
_COUNT_FILES = {"genes": ".genes.results", "isoforms": ".isoforms.results", "calls": CALLS}
_LANDED = "bundle_fqid string, ordinal int, value string, kind string, part int"
#: Parts of a landing table by a hash of the bundle's name, of which a batch reads those of its bundles.
PARTS = 16


def _part() -> Column:
    return F.pmod(F.xxhash64("bundle_fqid"), F.lit(PARTS)).cast("int").alias("part")


def start_landing(
    spark: SparkSession, root: str, out: str, checkpoint: str, files_per_batch: int = 10_000, available_now: bool = False
) -> list[StreamingQuery]:
    """Keep the landing table ``out`` up with the bundle directories below ``root``: three streams of files.

    JSON documents, manifests and count files come as whole texts, parted by kind and by a hash of the bundle's name;
    dense rows and their axes as they are. Each batch is a folder of its own, so a batch that comes again overwrites
    itself. A file is taken once, when it appears: what changes is delivered as another version of its bundle.
    """
    file = F.col("_metadata.file_path")

    def stream(source: DataFrame, name: str, folders: list[str]) -> StreamingQuery:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").partitionBy(*folders).parquet(os.path.join(out, name, f"batch={number}"))

        writer = source.writeStream.queryName(f"landing-{name}").option("checkpointLocation", os.path.join(checkpoint, name))
        return (writer.trigger(availableNow=True) if available_now else writer).foreachBatch(keep).start()

    reader = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    texts = reader.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.{json,results,csv}").load(root)
    kind = F.regexp_extract(file, r"([^/]+?)(?:_\d+)?\.json$", 1)
    for name, end in _COUNT_FILES.items():
        kind = F.when(file.endswith(end), name).otherwise(kind)
    texts = texts.select(bundle_name(file).alias("bundle_fqid"), document_number(file).alias("ordinal"), "value", kind.alias("kind"))
    texts = texts.filter(F.col("kind").isin(*DOCUMENTS, "manifest", *_COUNT_FILES)).select("*", _part())
    queries = [stream(texts, "texts", ["kind", "part"])]
    for name, schema in (("chunks", CHUNKS), ("axis", AXIS)):
        dense = reader.format("parquet").schema(schema).option("pathGlobFilter", f"{name}*.parquet").load(root)
        queries.append(stream(dense.select("*", _part()), name, ["part"]))
    return queries


def read_landing(spark: SparkSession, out: str, bundles: DataFrame | None = None) -> Landing:
    """What :func:`start_landing` has brought in: of all bundles, or of ``bundles`` (``bundle_fqid``).

    Bundles are matched by a join, so any number of them can be asked for; of the table only the parts are read in
    which some of them lie.
    """

    wanted = None if bundles is None else build_side(bundles.select("bundle_fqid").distinct())

    def landed(name: str, schema: str) -> DataFrame:
        path = os.path.join(out, name)
        rows = _or_empty(lambda: spark.read.schema(schema).option("basePath", path).parquet(path), spark, schema, [path])
        if wanted is None:
            return rows
        # At most one row for each part; the comparison keeps them all and lets Spark prune by them at run time.
        parts = wanted.select(_part().alias("own")).distinct().filter(F.col("own") >= 0)
        return rows.join(F.broadcast(parts), rows["part"] == parts["own"], "left_semi").join(wanted, "bundle_fqid", "left_semi")

    texts = landed("texts", _LANDED)
    of = lambda kind: texts.filter(F.col("kind") == kind)
    return Landing(
        documents={kind: parse(of(kind), schema) for kind, schema in DOCUMENTS.items()},
        manifests=parse(of("manifest"), MANIFEST),
        genes=counts_of(of("genes"), "genes"),
        isoforms=counts_of(of("isoforms"), "isoforms"),
        calls=calls_of(of("calls")),
        chunks=landed("chunks", f"{CHUNKS}, part int").drop("part", "batch"),
        axis=landed("axis", f"{AXIS}, part int").drop("part", "batch"),
    )
