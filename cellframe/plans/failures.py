"""A lasting log of what could not be loaded: one row per entity and reason, over all loads and batches."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellframe.schemas import table
from cellframe.session import build_side

LOG = table("entity!", "reason!", "bundle", "first_run long", "last_run long", "times long", "first_seen timestamp", "last_seen timestamp", "closed_at timestamp")
_RUNS = table("seq long!", "source", "number long", "at timestamp")


def bundle_of(entity: Column) -> Column:
    """The bundle of an entity: ``bundle``, ``bundle/document`` or ``bundle/barcode``."""
    return F.split_part(entity, F.lit("/"), F.lit(1))


class FailureLog:
    """Failures under ``root``; one writer at a time.

    A run (a load, or a batch of a stream) hands in its failures and the bundles that it loaded. A failure seen before
    gets a later last time and one more; the open ones of a bundle that has now been loaded without a failure are
    closed, and one that comes back is opened again. A run is told by ``source`` and ``number``: merged a second time
    it changes nothing, so a restart may repeat it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root

    def read(self) -> DataFrame:
        """Every failure, open (``closed_at`` null) or closed."""
        newest = self._runs().agg(F.max("seq")).first()[0]
        return self.spark.createDataFrame([], LOG) if newest is None else self.spark.read.schema(LOG).parquet(self._place(newest))

    def open(self) -> DataFrame:
        return self.read().filter("closed_at IS NULL")

    def merge(self, failures: DataFrame, loaded: DataFrame, source: str, number: int, at: Column | None = None) -> bool:
        """Take in a run's ``failures`` (``entity``, ``reason``) and ``loaded`` bundles (``bundle_fqid``); was it new?

        A failure that a run names several times counts once. Null entities and reasons count as empty ones.
        """
        runs = self._runs()
        if not runs.filter((F.col("source") == source) & (F.col("number") == number)).isEmpty():
            return False
        seq = (runs.agg(F.max("seq")).first()[0] or 0) + 1
        now = F.current_timestamp() if at is None else at
        blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
        new = failures.select(blank("entity"), blank("reason")).distinct().withColumn("new", F.lit(True))
        faulty = build_side(new.select(bundle_of(F.col("entity")).alias("bundle")).distinct())
        sound = loaded.select(F.col("bundle_fqid").alias("bundle")).distinct().join(faulty, "bundle", "left_anti").withColumn("sound", F.lit(True))
        both = self.read().drop("bundle").join(new, ["entity", "reason"], "full").withColumn("bundle", bundle_of(F.col("entity")))
        both = both.join(build_side(sound), "bundle", "left")
        seen, run = F.col("new").isNotNull(), F.lit(seq).cast("long")
        closed = F.when(seen, F.lit(None)).otherwise(F.coalesce("closed_at", F.when(F.col("sound"), now)))
        merged = both.select(
            "entity", "reason", "bundle",
            F.coalesce("first_run", run).alias("first_run"),
            F.when(seen, run).otherwise(F.col("last_run")).alias("last_run"),
            (F.coalesce("times", F.lit(0)) + seen.cast("long")).alias("times"),
            F.coalesce("first_seen", now).alias("first_seen"),
            F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
            closed.cast("timestamp").alias("closed_at"),
        )
        merged.write.mode("overwrite").parquet(self._place(seq))
        # The run counts from here on; what was written before is overwritten by the next attempt.
        told = self.spark.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(source).alias("source"), F.lit(number).cast("long").alias("number"), now.cast("timestamp").alias("at"))
        told.write.mode("append").json(os.path.join(self.root, "runs"))
        return True

    def _place(self, seq: int) -> str:
        return os.path.join(self.root, "log", f"seq={seq}")

    def _runs(self) -> DataFrame:
        try:
            return self.spark.read.schema(_RUNS).json(os.path.join(self.root, "runs"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _RUNS)
