"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_T = TypeVar("_T")


def build_session(app: str = "cellframe", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings given by ``spark-submit`` win where set there."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cellframe-"))
    return context.getCheckpointDir()


def durable(frame: DataFrame, name: str = "step") -> DataFrame:
    """Write ``frame`` once to the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, known statistics for join planning, and
    the same contents each time it is read.
    """
    spark = frame.sparkSession
    path = os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Rows up to which the build side of a join may be sent to every task; in the driver's memory some hundred bytes each.
MOST_SENT = 100_000


def build_side(frame: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``frame`` as the side of a join that Spark may broadcast, but only while it has at most ``most`` rows.

    Spark judges a table by the size of its files. Keys and repeated texts shrink to a few bytes a row there, but as a
    broadcast each row takes its full room in the driver, once for every query that runs at the time. A list that grows
    with the data is therefore counted, and a long one is joined by sorting.
    """
    return frame.hint("merge") if frame.limit(most + 1).count() > most else frame


def together(spark: SparkSession, tasks: Iterable[Callable[[], _T]], threads: int = 8) -> list[_T]:
    """Run independent Spark actions at the same time, so that small ones do not wait for large ones."""
    with ThreadPoolExecutor(threads) as pool:
        return [job.result() for job in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]
