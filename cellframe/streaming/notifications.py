"""Bundle notifications: a stream of create, update, delete and tombstone events applied to a store."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cellframe import fixed
from cellframe.operators.keyed import latest
from cellframe.plans.failures import FailureLog
from cellframe.plans.isolate import Failure, apply_apart
from cellframe.plans.ingest import ingest_bundles, seen_bundles
from cellframe.plans.store import Store
from cellframe.schemas import NOTIFICATION
from cellframe.session import durable
from cellframe.sources.bundles import Landing


def read_notifications(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Notifications dropped as JSON files into a folder, at most so many files at a time."""
    return spark.readStream.schema(NOTIFICATION).option("maxFilesPerTrigger", files_per_batch).json(folder)


def action(event_type: Column) -> Column:
    """``upsert``, ``remove``, or ``invalid`` for any other type."""
    return (
        F.when(event_type.isin(*fixed.UPSERT_EVENTS), "upsert")
        .when(event_type.isin(*fixed.REMOVE_EVENTS), "remove")
        .otherwise("invalid")
    )


def route(notifications: DataFrame) -> DataFrame:
    """Add ``bundle_fqid`` and ``action``; a notification without bundle, version or type is invalid."""
    complete = (
        F.col("bundle_uuid").isNotNull() & F.col("bundle_version").isNotNull() & F.col("event_type").isNotNull()
    )
    return notifications.withColumn("bundle_fqid", F.concat_ws(".", "bundle_uuid", "bundle_version")).withColumn(
        "action", F.when(complete, action(F.col("event_type"))).otherwise("invalid")
    )


def decide(routed: DataFrame) -> DataFrame:
    """The newest valid notification of each bundle: within a batch the last one wins."""
    return latest(routed.filter("action != 'invalid'"), "bundle_fqid", "seq")


class NotificationHandler:
    """Applies batches of notifications to a store.

    ``landing`` gives what has arrived for a frame of bundles (``bundle_fqid``), such as ``sources.bundles.read_landing``
    does; no names pass through the driver. A batch that was published before is skipped, so a restart repeats nothing;
    applying one again would give the same tables anyway.

    With ``dead_letters``, a folder, a batch that fails is tried again and then halved until the bundles that make it fail
    are alone. Those go to the dead letters with the error, and the stream goes on (see ``plans.isolate``); without it the
    stream stops. With ``log``, what was set aside is also kept in a lasting log, and closed when its bundle loads.
    """

    def __init__(
        self,
        store: Store,
        landing: Callable[[DataFrame], Landing],
        labels: DataFrame,
        quarantine: str,
        name: str = "notifications",
        dead_letters: str | None = None,
        log: FailureLog | None = None,
        attempts: int = 2,
        most_dead: int = 100,
    ) -> None:
        self.store = store
        self.landing = landing
        self.labels = labels
        self.quarantine = quarantine
        self.name = name
        self.dead_letters = dead_letters
        self.log = log
        self.attempts = attempts
        self.most_dead = most_dead

    def __call__(self, batch: DataFrame, batch_id: int, stream: str = "") -> None:
        source = f"{self.name}/{stream}"
        if self.store.has_batch(source, batch_id):
            return
        routed = durable(route(batch), "notifications")
        decided = durable(decide(routed), "decided")
        set_aside = [
            routed.filter("action = 'invalid'").select(
                F.col("bundle_fqid").alias("entity"),
                F.concat(F.lit("invalid event type "), F.coalesce("event_type", F.lit("(none)"))).alias("reason"),
            )
        ]
        if self.dead_letters is None:
            set_aside += self._apply(decided, source, batch_id)
        else:
            calls: list[DataFrame] = []
            failures = apply_apart(decided, "bundle_fqid", lambda part: calls.extend(self._apply(part)), self.attempts, self.most_dead)
            set_aside += calls
            self._bury(decided, failures, stream, batch_id)
        rejected = reduce(DataFrame.unionByName, set_aside)
        # Written per stream and batch, so that a repeated batch overwrites its own rows.
        rejected.withColumn("logged_at", F.current_timestamp()).write.mode("overwrite").json(f"{self.quarantine}/stream={stream}/batch={batch_id}")
        if self.log is not None:
            invalid = routed.filter("action = 'invalid'").select("bundle_fqid").distinct()
            updated = decided.filter("action = 'upsert'").select("bundle_fqid").join(invalid, "bundle_fqid", "left_anti")
            now = self.store.read("analysis").select("bundle_fqid").distinct()
            self.log.merge(rejected, updated.join(now, "bundle_fqid", "left_semi"), source, batch_id)
        if self.dead_letters is not None and not decided.isEmpty():
            self.store.apply(None, None, source, batch_id)  # the parts are published; now the batch counts as done

    def _apply(self, decided: DataFrame, source: str | None = None, batch_id: int | None = None) -> list[DataFrame]:
        """Publish removals and updates as one version; what was set aside, as ``(entity, reason)``."""
        updates = decided.filter("action = 'upsert'").select("bundle_fqid")
        removals = decided.filter("action = 'remove'").select("bundle_fqid")
        tables, set_aside = None, []
        if not updates.isEmpty():
            landing = self.landing(updates)
            tables, quarantined = ingest_bundles(landing, self.labels)
            quarantined = durable(quarantined, "quarantined").drop("logged_at")
            absent = updates.join(seen_bundles(landing), "bundle_fqid", "left_anti").select(
                F.col("bundle_fqid").alias("entity"), F.lit("not in the landing zone").alias("reason")
            )
            set_aside = [quarantined, durable(absent, "absent")]
        if tables is not None or not removals.isEmpty():
            self.store.apply(tables, removals, source, batch_id)
        return set_aside

    def _bury(self, decided: DataFrame, failures: list[Failure], stream: str, batch_id: int) -> None:
        """Keep the notifications that failed alone; there are ``most_dead`` at most."""
        if not failures:
            return
        spark = decided.sparkSession
        found = spark.createDataFrame([(f.key, f.attempts, f.reason) for f in failures], "bundle_fqid string, attempts int, reason string")
        letters = decided.join(found, "bundle_fqid").withColumn("buried_at", F.current_timestamp())
        letters.write.mode("overwrite").json(f"{self.dead_letters}/stream={stream}/batch={batch_id}")


_LETTERS = T.StructType(
    [*NOTIFICATION.fields, T.StructField("bundle_fqid", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("buried_at", T.TimestampType())]
)


def read_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The notifications that could not be applied, with the reason. As a batch they can be handed to a handler again."""
    try:
        return spark.read.schema(_LETTERS).json(folder).select(*_LETTERS.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LETTERS)


def start_notifications(
    notifications: DataFrame, handler: NotificationHandler, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start applying a stream of notifications; ``available_now`` stops when what is there has been applied."""
    spark = handler.store.spark

    def apply(batch: DataFrame, batch_id: int) -> None:
        # Batches are counted per checkpoint: a stream that starts afresh has another id and is not skipped.
        stream = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        handler(batch, batch_id, stream)

    writer = notifications.writeStream.queryName(handler.name).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(apply).start()
