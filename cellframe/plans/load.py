"""A whole load: bundles selected, taken in by waves, verified, and only then published."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cellframe import fixed
from cellframe.operators.prefix import in_order, running
from cellframe.plans import audits
from cellframe.plans.failures import FailureLog, bundle_of
from cellframe.plans.ingest import bundle_summary, ingest_bundles
from cellframe.plans.selection import select_bundles
from cellframe.plans.store import Store
from cellframe.schemas import WAREHOUSE, table
from cellframe.session import build_side, durable, together
from cellframe.sources.bundles import Landing

_WAVES = table("bundle_fqid!", "wave long!")
_FAILED = table("entity", "reason")
_DONE = table("wave long!")
# The step before the first wave.
_SELECTED = -1


class IncompleteLoad(RuntimeError):
    """Selected bundles are neither in the tables nor among the failures; nothing was published."""


@dataclass(frozen=True)
class Loaded:
    """What a load came to: the version published, bundles selected, in the tables and failed, waves taken in now."""

    version: int
    selected: int
    loaded: int
    failed: int
    waves_run: int


class Load:
    """A load under ``root``, which can be stopped at any time and started again with the same ``root``.

    The bundles to load are selected once and dealt to waves of ``bundles_per_wave`` by the order of their names, so that
    no more than a wave is worked on at a time. A wave writes its rows and its failures and is then marked as done; a
    restart takes in the waves without a mark. When all are done, every selected bundle must have an analysis row or a
    failure, else :class:`IncompleteLoad` is raised and readers keep the version they have.
    """

    def __init__(self, spark: SparkSession, root: str, bundles_per_wave: int = 10_000) -> None:
        self.spark = spark
        self.root = root
        self.bundles_per_wave = bundles_per_wave

    def select(self, landing: Landing, projects: list[str] | None = None, bundles: DataFrame | None = None) -> DataFrame:
        """``(bundle_fqid, wave)`` of the bundles to load; those of an earlier start, where there was one."""
        if not self._done(_SELECTED):
            # Written first, since putting it in order reads it twice.
            chosen = durable(select_bundles(bundle_summary(landing), projects, bundles).distinct(), "chosen")
            dealt = running(in_order(chosen, ["bundle_fqid"]), number=F.lit(1))
            wave = F.call_function("div", F.col("number"), F.lit(self.bundles_per_wave))
            dealt.select("bundle_fqid", wave.alias("wave")).write.mode("overwrite").parquet(self._place("selected"))
            self._mark(_SELECTED)
        return self._read("selected", _WAVES)

    def run(
        self,
        store: Store,
        landing: Landing,
        labels: DataFrame,
        log: FailureLog,
        features: DataFrame | None = None,
        projects: list[str] | None = None,
        bundles: DataFrame | None = None,
    ) -> Loaded:
        """Select, take in what is not done, verify, publish the tables as a new version and merge the failures."""
        selected = self.select(landing, projects, bundles)
        # One number for each wave, of some thousand bundles.
        waves = [r["wave"] for r in selected.select("wave").distinct().orderBy("wave").collect()]
        missing = [w for w in waves if not self._done(w)]
        for wave in missing:
            self._take_in(wave, landing.restrict(selected.filter(F.col("wave") == wave)), labels)
        tables = self.tables() | ({} if features is None else {"feature": features})
        failures = self._read("failures", _FAILED)
        failed = failures.select(bundle_of(F.col("entity")).alias("bundle_fqid")).distinct()
        loaded = build_side(tables["analysis"].select("bundle_fqid").distinct())
        settled = build_side(loaded.union(failed).distinct())
        lost = audits.missing_bundles(selected.select("bundle_fqid"), settled, "bundle_fqid")
        if not lost.isEmpty():
            raise IncompleteLoad(f"neither loaded nor failed: {', '.join(str(r[0]) for r in lost.limit(5).collect())}")
        version = store.reload(tables)
        log.merge(failures, loaded, f"load/{self.root}", version)
        return Loaded(version, selected.count(), loaded.count(), selected.join(loaded, "bundle_fqid", "left_anti").count(), len(missing))

    def tables(self) -> dict[str, DataFrame]:
        """The rows of all waves. Bundles of several waves can bring the same dimension row; each key stays once.

        Of rows that differ the greatest stays, whatever wave it came from, so a load gives the same tables however it
        was cut.
        """
        return {name: self._once(name, self._read(f"tables/{name}", WAREHOUSE[name])) for name in WAREHOUSE if name != "feature"}

    def _once(self, name: str, rows: DataFrame) -> DataFrame:
        if name in ("cell", "expression", "analysis"):
            return rows  # these belong to one bundle, and it to one wave
        if name in ("contributor", "publication"):
            return rows.distinct()
        key = fixed.UPSERT_KEYS[name]
        rest = F.struct(*(c for c in rows.columns if c != key))
        return rows.groupBy(key).agg(F.max(rest).alias("one")).select(key, "one.*").select(*rows.columns)

    def _take_in(self, wave: int, landing: Landing, labels: DataFrame) -> None:
        tables, failures = ingest_bundles(landing.kept(), labels)

        def write(name: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(os.path.join(self._place(name), f"wave={wave}"))

        parts: Mapping[str, DataFrame] = {f"tables/{n}": f for n, f in tables.items()} | {"failures": failures.select(*_FAILED.names)}
        # Each of these has a plan of dozens of joins, which the driver holds with all its tasks while it runs.
        together(self.spark, [lambda n=name, f=frame: write(n, f) for name, frame in parts.items()], threads=3)
        self._mark(wave)

    def _mark(self, step: int) -> None:
        self.spark.createDataFrame([(step,)], _DONE).write.mode("append").json(self._place("done"))

    def _done(self, step: int) -> bool:
        return not self._read("done", _DONE).filter(F.col("wave") == step).isEmpty()

    def _place(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(schema)
        try:
            return reader.json(self._place(name)) if name == "done" else reader.parquet(self._place(name)).select(*schema.names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
