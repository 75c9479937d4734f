"""The request log: cached results, invalidation, expiry, status and durations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from cellframe import fixed
from cellframe.functions import text


def matching(log: DataFrame, attributes: Mapping[str, Any]) -> DataFrame:
    """Rows whose columns equal every given value; ``None`` asks for a missing one."""
    tests = [F.col(name).eqNullSafe(value) for name, value in attributes.items()]
    return log.filter(reduce(and_, tests)) if tests else log


def result_key() -> Column:
    return text.result_key(F.col("data_version"), F.col("request_hash"), F.col("request_id"), F.col("format"))


def cached_result(log: DataFrame, results: DataFrame, version: Column, fingerprint: Column) -> DataFrame:
    """The first stored result, by key, of a data version and fingerprint; no row when there is none."""
    wanted = log.filter((F.col("data_version") == version) & (F.col("request_hash") == fingerprint))
    stored = wanted.select(result_key().alias("result_key")).join(results, "result_key", "left_semi")
    return stored.agg(F.min("result_key").alias("result_key")).filter(F.col("result_key").isNotNull())


def cached_results(log: DataFrame, results: DataFrame) -> DataFrame:
    """``(data_version, request_hash, result_key)``: what the look-up finds for every fingerprint of the log."""
    return (
        log.withColumn("result_key", result_key())
        .join(results.select("result_key").distinct(), "result_key", "left_semi")
        .groupBy("data_version", "request_hash")
        .agg(F.min("result_key").alias("result_key"))
    )


def invalidated(log: DataFrame, ids: DataFrame, hashes: DataFrame, version: int) -> DataFrame:
    """``(request_id, result_key)`` to invalidate: the given ids, and unfailed requests of the given fingerprints."""
    by_hash = matching(log, {"data_version": version, "error": None}).join(
        hashes.select("request_hash").distinct(), "request_hash", "left_semi"
    )
    by_id = log.join(ids.select("request_id").distinct(), "request_id", "left_semi")
    return by_id.unionByName(by_hash).select("request_id", result_key().alias("result_key")).distinct()


def mark_invalidated(log: DataFrame, doomed: DataFrame, message: str = "This result was deleted; ask for it again.") -> DataFrame:
    """The log with an error on every invalidated request."""
    marks = doomed.select("request_id", F.lit(message).alias("mark")).distinct()
    return (
        log.join(marks, "request_id", "left").withColumn("error", F.coalesce("mark", "error")).drop("mark")
    )


def is_expired(now: Column) -> Column:
    """Older than the retention time, and the result is gone."""
    return (F.col("created") < now - F.expr(f"INTERVAL {fixed.RESULT_DAYS} DAYS")) & F.col("result_size").isNull()


def timed_out(now: Column) -> Column:
    """Started longer ago than a request may run."""
    return F.col("created") < now - F.expr(f"INTERVAL {fixed.TIMEOUT_HOURS} HOURS")


def status(log: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """``(request_id, status, reason)`` of every request; ``results`` lists ``(result_key, result_size)``.

    The first rule that holds decides.
    """
    joined = (
        log.withColumn("created", text.parse_timestamp(F.col("creation_date")))
        .withColumn("result_key", result_key())
        .join(results, "result_key", "left")
    )
    rules = [
        (F.col("format").isNull(), fixed.IN_PROGRESS, "accepted"),
        (F.coalesce(F.col("error"), F.lit("")) != "", fixed.FAILED, "error"),
        (F.coalesce(F.col("job_status"), F.lit("")) == "FAILED", fixed.FAILED, "job"),
        (F.col("result_size") == fixed.EMPTY_SIZE, fixed.COMPLETE, "empty"),
        (F.col("result_size").isNotNull(), fixed.COMPLETE, "stored"),
        (is_expired(now), fixed.EXPIRED, "expired"),
        (timed_out(now), fixed.FAILED, "timeout"),
    ]
    outcome = F.when(F.lit(False), F.struct(F.lit("").alias("status"), F.lit("").alias("reason")))
    for test, state, reason in rules:
        outcome = outcome.when(test, F.struct(F.lit(state).alias("status"), F.lit(reason).alias("reason")))
    running = F.struct(F.lit(fixed.IN_PROGRESS).alias("status"), F.lit("running").alias("reason"))
    return joined.withColumn("outcome", outcome.otherwise(running)).select("request_id", "outcome.*")


def lookup_status(ids: DataFrame, log: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Status of asked ids; an id the log does not know has status null and reason ``unknown``."""
    known = status(log, results, now)
    return ids.join(known, "request_id", "left").withColumn(
        "reason", F.coalesce("reason", F.lit("unknown"))
    )


def duration_rollup(finished: DataFrame) -> DataFrame:
    """Mean duration and number of requests by size interval and format, and by interval alone.

    ``finished`` has ``num_bundles``, ``format`` and ``duration`` in seconds; the coarser level has a null format
    and ``level`` 1.
    """
    frame = finished.withColumn("bundles", text.bundle_interval(F.col("num_bundles")))
    return frame.groupingSets(
        [[F.col("bundles"), F.col("format")], [F.col("bundles")]], F.col("bundles"), F.col("format")
    ).agg(
        F.grouping("format").cast("int").alias("level"),
        F.count(F.lit(1)).alias("requests"),
        F.avg("duration").alias("mean_duration"),
    )
