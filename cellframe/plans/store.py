"""Versioned warehouse tables on Parquet.

Cells lie in buckets of the analysis that owns them, and values in the bucket of their cell, parted by kind of value;
the other tables have one bucket. So a bundle's cells and values lie together: a new version rewrites only the buckets
of the bundles that it changes, and a reader of some bundles reads theirs. The number of buckets is written with the
first version and read from there. A version lists where every bucket of every table lies; readers first resolve the
current version, so they always see tables that belong together. One writer at a time is assumed.
"""

from __future__ import annotations

import os
from collections.abc import Collection, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cellframe import fixed
from cellframe.functions.text import format_timestamp
from cellframe.operators.keyed import concat, remove, upsert
from cellframe.plans import audits
from cellframe.plans.ingest import empty_tables
from cellframe.plans.journal import Journal, newest
from cellframe.schemas import WAREHOUSE, table
from cellframe.session import build_side, durable, together

_LISTING = table("table!", "bucket int!", "written int!")
_POINTER = table("seq long!", "version int!", "source", "batch long")
_VERSIONS = table("version int!", "creation_date", "schema_versions")
_PROJECTS = table("version int!", "projectkey", "cells long")
_LAYOUT = table("buckets int!")

# Columns by which a bucket is parted into folders, and those behind the upsert key by which its files are sorted.
_FOLDERS = {"expression": ["exprtype"]}
_ORDER = {"expression": ["featurekey"]}
# The bucket of values whose cell isn't there.
_NO_OWNER = fixed.NO_BUCKET
# The tables whose rows say in which bucket they lie.
_BUCKETED = ("cell", "expression")


class ContradictingLayout(ValueError):
    """The store is laid out in another way than asked for."""


class UnknownVersion(ValueError):
    """The data version was never published."""


def cascade(analysis: DataFrame, cell: DataFrame, bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(analyses, cells)`` that go when the bundles (``bundle_fqid``) go; values go with their cell."""
    doomed_analyses = analysis.join(bundles.select("bundle_fqid").distinct(), "bundle_fqid", "left_semi")
    doomed_cells = cell.join(doomed_analyses.select("analysiskey").distinct(), "analysiskey", "left_semi")
    return doomed_analyses, doomed_cells


class Store:
    """Warehouse tables under ``root``.

    ``buckets`` is the number of buckets of the two tables that grow, 64 unless the store has another already; a number
    that contradicts the stored one is refused. ``log_block`` is the number of versions after which the logs begin a new
    block, so that finding the current version reads no more files than that, whatever the number of versions.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, log_block: int = 64) -> None:
        self.spark = spark
        self.root = root
        self._asked = buckets
        self._pointer = Journal(spark, os.path.join(root, "pointer"), _POINTER, newest("seq", "source"), log_block)
        self._versions = Journal(spark, os.path.join(root, "data_version"), _VERSIONS, newest("version"), log_block)

    @property
    def buckets(self) -> int:
        stored = self._log("layout", _LAYOUT).agg(F.max("buckets")).first()[0]
        if stored is not None and self._asked not in (None, stored):
            raise ContradictingLayout(f"the store has {stored} buckets, not {self._asked}")
        return stored or self._asked or 64

    # -- reading

    def current(self) -> int:
        """The version readers get; 0 before the first load."""
        latest = self._pointer.recent().agg(F.max_by("version", "seq")).first()[0]
        return latest or 0

    def data_versions(self) -> DataFrame:
        """Every published version."""
        return self._versions.all()

    def project_cells(self) -> DataFrame:
        """``(version, projectkey, cells)`` of every version that was loaded whole or bumped."""
        return self._log("project_cells", _PROJECTS)

    def read(self, name: str, version: int | None = None, buckets: Collection[int] | None = None) -> DataFrame:
        """A table at a version, or only some of its buckets."""
        version = self.current() if version is None else version
        return self._listed(name, self._places(version), buckets)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """Every table at a version; cells and values also say in which bucket they lie.

        A :class:`~cellframe.plans.request.MatrixRequest` over these tables reads the buckets of its cells alone.
        """
        version = self.current() if version is None else version
        places = self._places(version)
        return {name: self._listed(name, places, bucketed=name in _BUCKETED) for name in WAREHOUSE}

    def tables_of(self, cells: DataFrame, version: int | None = None) -> dict[str, DataFrame]:
        """The tables, but of cells and values only the buckets in which ``cells`` (``analysiskey``) lie."""
        places = self._places(self.current() if version is None else version)
        lie = {row["b"] for row in cells.select(self._owner_bucket(self.buckets).alias("b")).distinct().collect()}
        return {name: self._listed(name, places, lie if name in ("cell", "expression") else None) for name in WAREHOUSE}

    # -- writing

    def create(self) -> int:
        """Publish empty tables."""
        return self.reload(empty_tables(self.spark))

    def reload(self, tables: Mapping[str, DataFrame]) -> int:
        """Publish exactly these tables; tables not given are empty."""
        version, buckets = self._next(), self.buckets
        given = [name for name in WAREHOUSE if name in tables and name != "expression"]

        def load(name: str, owners: DataFrame | None = None) -> list[tuple[str, int, int]]:
            return [(name, b, version) for b in self._write(name, tables[name], version, buckets, owners)]

        places = sum(together(self.spark, [lambda n=name: load(n) for name in given]), [])
        if "expression" in tables:
            places += load("expression", self._owners(places, buckets))
        return self._publish(version, places, count_cells=True)

    def upsert(self, tables: Mapping[str, DataFrame]) -> int:
        """Replace rows by key in every given table except ``feature``."""
        return self.apply(tables, None)

    def remove(self, bundles: DataFrame) -> int:
        """Remove the bundles (``bundle_fqid``): their values, cells and analyses. Dimension rows stay."""
        return self.apply(None, bundles)

    def apply(
        self,
        tables: Mapping[str, DataFrame] | None,
        removals: DataFrame | None,
        source: str | None = None,
        batch: int | None = None,
    ) -> int:
        """Remove, then upsert, and publish both as one version."""
        base, version, buckets = self.current(), self._next(), self.buckets
        doomed = self._doomed(base, removals) if removals is not None else {}
        staged = {name: build_side(durable(frame, f"staged-{name}")) for name, frame in (tables or {}).items() if name != "feature"}
        places = self._places(base)
        cells = self._listed("cell", places)
        owners = self._owners(places, buckets)

        def changed(name: str, touched: set[int], owners: DataFrame | None = None) -> None:
            """Rewrite the touched buckets of a table and list them in place of the old ones."""
            nonlocal places
            if not touched:
                return
            stay = owners is not None and "cell" not in staged and self._one_owner(owners)
            rows = self._listed(name, places, touched, bucketed=stay)
            if name in doomed:
                rows = self._without(name, rows, doomed[name])
            if stay:
                # Values that stay lie where their cell does; only new ones have to meet their cell.
                rows = rows.withColumnRenamed(fixed.BUCKET, "bucket")
                if name in staged:
                    rows = remove(rows, staged[name], fixed.UPSERT_KEYS[name]).unionByName(self._by_owner(staged[name], owners))
            elif name in staged:
                rows = upsert(rows, staged[name], fixed.UPSERT_KEYS[name])
            written = self._write(name, rows, version, buckets, owners)
            places = [p for p in places if p[0] != name or p[1] not in touched] + [(name, b, version) for b in written]

        for name in WAREHOUSE:
            if name not in ("cell", "expression") and (name in doomed or name in staged):
                changed(name, {0})
        own, moved = self._owner_bucket(buckets).alias("b"), set()
        if "cell" in staged:
            before = cells.join(staged["cell"].select("cellkey"), "cellkey", "left_semi").select("cellkey", own)
            after = staged["cell"].select("cellkey", self._owner_bucket(buckets).alias("now"))
            moves = after.join(before, "cellkey").filter("b <> now").select(F.explode(F.array("b", "now")).alias("b"))
            moved = self._buckets_in(moves)
            new = self._buckets_in(before.select("b"), after.select(F.col("now").alias("b")))
            changed("cell", new | (self._buckets_in(doomed["cell"].select(own)) if "cell" in doomed else set()))
            moved |= {_NO_OWNER} & {b for t, b, _ in places if t == "expression"}
        elif "cell" in doomed:
            changed("cell", self._buckets_in(doomed["cell"].select(own)))
        touched = set(moved)
        if "expression" in doomed:
            touched |= self._buckets_in(doomed["expression"].select(own))
        now = self._owners(places, buckets)
        if "expression" in staged:
            keys = staged["expression"].select("cellkey").distinct()
            lie = F.coalesce("b", F.lit(_NO_OWNER)).alias("b")
            # Where no cell changes, cells lie now where they lay before.
            lay = (owners, now) if "cell" in staged or "cell" in doomed else (now,)
            touched |= self._buckets_in(*(keys.join(o, "cellkey", "left").select(lie) for o in lay))
        changed("expression", touched, now)
        return self._publish(version, places, source, batch)

    def bump(self) -> int:
        """Publish the current tables again under the next version."""
        return self._publish(self._next(), self._places(self.current()), count_cells=True)

    def set_version(self, version: int) -> None:
        """Let readers see an earlier version."""
        if self.data_versions().filter(F.col("version") == version).isEmpty():
            raise UnknownVersion(str(version))
        self._point(version, None, None)

    def has_batch(self, source: str, batch: int) -> bool:
        """Was this batch of this stream published already? Batches of a stream are published in ascending order."""
        return not self._pointer.recent().filter((F.col("source") == source) & (F.col("batch") >= batch)).isEmpty()

    def verify(self, expected: DataFrame) -> DataFrame:
        """Expected bundles without an analysis row."""
        return audits.missing_bundles(expected, self.read("analysis"))

    # -- layout

    def _doomed(self, base: int, bundles: DataFrame) -> dict[str, DataFrame]:
        analyses, cells = cascade(self.read("analysis", base), self.read("cell", base), bundles)
        analyses = build_side(durable(analyses, "doomed-analysis"))
        cells = build_side(durable(cells.select("cellkey", "analysiskey"), "doomed-cell"))
        return {"expression": cells, "cell": cells, "analysis": analyses}

    def _without(self, name: str, rows: DataFrame, gone: DataFrame) -> DataFrame:
        # A cell goes with its analysis, an analysis with its bundle, a value with its cell.
        key = {"expression": "cellkey", "cell": "analysiskey", "analysis": "bundle_fqid"}[name]
        return remove(rows, gone, key)

    @staticmethod
    def _owner_bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("analysiskey"), F.lit(buckets)).cast("int")

    def _owners(self, places: list[tuple[str, int, int]], buckets: int) -> DataFrame:
        """``(cellkey, b)``: the bucket of every cell, and so of its values."""
        return self._listed("cell", places).select("cellkey", self._owner_bucket(buckets).alias("b"))

    @staticmethod
    def _one_owner(owners: DataFrame) -> bool:
        """Is every cell there once? Only then is a stored value the one that a join with its cell gives."""
        return audits.duplicate_keys(owners.filter("cellkey IS NOT NULL"), "cellkey").isEmpty()

    @staticmethod
    def _by_owner(rows: DataFrame, owners: DataFrame) -> DataFrame:
        """Values with the bucket of their cell."""
        return rows.join(build_side(owners.withColumnRenamed("b", "bucket")), "cellkey", "left").fillna(_NO_OWNER, ["bucket"])

    @staticmethod
    def _buckets_in(*frames: DataFrame) -> set[int]:
        # At most as many rows as there are buckets.
        return {row["b"] for row in concat(*frames).distinct().collect()}

    def _places(self, version: int) -> list[tuple[str, int, int]]:
        """``(table, bucket, version that wrote it)`` of everything that belongs to a version."""
        return [(row["table"], row["bucket"], row["written"]) for row in self._listing(version).collect()]

    def _listed(
        self, name: str, places: list[tuple[str, int, int]], buckets: Collection[int] | None = None, bucketed: bool = False
    ) -> DataFrame:
        paths = [self._bucket_path(name, v, b) for t, b, v in places if t == name and (buckets is None or b in buckets)]
        schema = T.StructType([*WAREHOUSE[name].fields, T.StructField("bucket", T.IntegerType())])
        if not paths:
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = self.spark.read.schema(schema).option("basePath", os.path.join(self.root, "tables", name)).parquet(*paths)
        return rows.select(*WAREHOUSE[name].names, *([F.col("bucket").alias(fixed.BUCKET)] if bucketed else []))

    def _bucket_path(self, name: str, version: int, bucket: int) -> str:
        return os.path.join(self.root, "tables", name, f"v={version}", f"bucket={bucket}")

    def _write(self, name: str, rows: DataFrame, version: int, buckets: int, owners: DataFrame | None = None) -> list[int]:
        """Write rows and return the buckets that got any; values go to the bucket that ``owners`` give their cell.

        Rows that have a ``bucket`` go there.
        Files are cut by ranges of bucket and key, so a large bucket is spread over several tasks.
        """
        path = os.path.join(self.root, "tables", name, f"v={version}")
        if "bucket" in rows.columns:
            placed = rows
        elif owners is not None:
            placed = self._by_owner(rows, owners)
        else:
            placed = rows.withColumn("bucket", self._owner_bucket(buckets) if name == "cell" else F.lit(0))
        folders = ["bucket", *_FOLDERS.get(name, [])]
        order = [*folders, fixed.UPSERT_KEYS[name], *_ORDER.get(name, [])]
        placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*folders).parquet(path)
        stored = self.spark.read.schema(table("bucket int")).parquet(path)
        return [row["bucket"] for row in stored.select("bucket").distinct().collect() if row["bucket"] is not None]

    def _next(self) -> int:
        return (self._versions.recent().agg(F.max("version")).first()[0] or 0) + 1

    def _listing(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], _LISTING)
        return self.spark.read.schema(_LISTING).parquet(os.path.join(self.root, "snapshots", f"v={version}"))

    def _publish(
        self,
        version: int,
        rows: list[tuple[str, int, int]],
        source: str | None = None,
        batch: int | None = None,
        count_cells: bool = False,
    ) -> int:
        if self._log("layout", _LAYOUT).isEmpty():
            self._append("layout", self.spark.createDataFrame([(self.buckets,)], _LAYOUT))
        listing = self.spark.createDataFrame(rows, _LISTING)
        listing.write.mode("overwrite").parquet(os.path.join(self.root, "snapshots", f"v={version}"))
        if count_cells:
            per_project = self.read("cell", version).groupBy("projectkey").agg(F.count(F.lit(1)).alias("cells"))
            self._append("project_cells", per_project.select(F.lit(version).alias("version"), "projectkey", "cells"))
        ranges = ", ".join(f"{k} {a}.{b}-{c}.{d}" for k, (a, b, c, d) in fixed.SCHEMA_VERSIONS.items())
        one = self.spark.range(1).select(
            F.lit(version).alias("version"),
            format_timestamp(F.current_timestamp()).alias("creation_date"),
            F.lit(ranges).alias("schema_versions"),
        )
        self._versions.append(one)
        self._point(version, source, batch)
        return version

    def _point(self, version: int, source: str | None, batch: int | None) -> None:
        seq = (self._pointer.recent().agg(F.max("seq")).first()[0] or 0) + 1
        self._pointer.append(self.spark.createDataFrame([(seq, version, source, batch)], _POINTER))

    def _append(self, log: str, rows: DataFrame) -> None:
        rows.write.mode("append").json(os.path.join(self.root, log))

    def _log(self, log: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(os.path.join(self.root, log))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing written yet
