import datetime

import pytest
from pyspark.sql import functions as F

from cellframe.functions import text
from cellframe.plans import requestlog
from cellframe.schemas import REQUEST_LOG

NOW = datetime.datetime(2020, 6, 30, 12, 0, 0)


def row(name, age_hours=1, hash_="h", version=1, format_="csv", job=None, error=None):
    created = (NOW - datetime.timedelta(hours=age_hours)).strftime("%Y-%m-%dT%H%M%S.%fZ")
    return (name, hash_, version, created, "Homo sapiens", format_, "gene", 10, job, error)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        row("new", format_=None),
        row("error", error="bad"),
        row("job", job="FAILED"),
        row("empty"),
        row("done", age_hours=2000),
        row("loom", format_="loom"),
        row("expired", age_hours=31 * 24),
        row("timeout", age_hours=37),
        row("running", age_hours=35),
        row("old-version", version=2, hash_="g"),
        row("failed-done", error="bad", hash_="g"),
    ]
    return spark.createDataFrame(rows, REQUEST_LOG)


@pytest.fixture(scope="module")
def results(spark):
    rows = [("1/h/empty.csv.zip", 0), ("1/h/done.csv.zip", 9), ("1/h/loom.loom", 5), ("1/g/failed-done.csv.zip", 5), ("2/g/old-version.csv.zip", 3)]
    return spark.createDataFrame(rows, "result_key string, result_size long")


def test_the_first_rule_that_holds_decides(spark, log, results):
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp")
    found = {r["request_id"]: (r["status"], r["reason"]) for r in requestlog.status(log, results, now).collect()}
    assert found == {
        "new": ("In Progress", "accepted"),
        "error": ("Failed", "error"),
        "job": ("Failed", "job"),
        "empty": ("Complete", "empty"),
        "done": ("Complete", "stored"),
        "loom": ("Complete", "stored"),
        "expired": ("Expired", "expired"),
        "timeout": ("Failed", "timeout"),
        "running": ("In Progress", "running"),
        "old-version": ("Complete", "stored"),
        "failed-done": ("Failed", "error"),
    }
    ids = spark.createDataFrame([("done",), ("nobody",)], "request_id string")
    asked = {r["request_id"]: (r["status"], r["reason"]) for r in requestlog.lookup_status(ids, log, results, now).collect()}
    assert asked == {"done": ("Complete", "stored"), "nobody": (None, "unknown")}


def test_cached_results(log, results):
    first = requestlog.cached_result(log, results, F.lit(1), F.lit("h")).collect()
    assert [r["result_key"] for r in first] == ["1/h/done.csv.zip"]
    assert requestlog.cached_result(log, results, F.lit(3), F.lit("h")).collect() == []
    every = {(r["data_version"], r["request_hash"]): r["result_key"] for r in requestlog.cached_results(log, results).collect()}
    assert every == {(1, "h"): "1/h/done.csv.zip", (1, "g"): "1/g/failed-done.csv.zip", (2, "g"): "2/g/old-version.csv.zip"}


def test_invalidation(spark, log):
    ids = spark.createDataFrame([("error",)], "request_id string")
    hashes = spark.createDataFrame([("g",)], "request_hash string")
    doomed = requestlog.invalidated(log, ids, hashes, version=2)
    assert sorted(map(tuple, doomed.collect())) == [("error", "1/h/error.csv.zip"), ("old-version", "2/g/old-version.csv.zip")]
    # A failed request of the fingerprint is not invalidated again.
    assert sorted(r[0] for r in requestlog.invalidated(log, ids, hashes, version=1).collect()) == ["error"]
    marked = {r["request_id"]: r["error"] for r in requestlog.mark_invalidated(log, doomed, "gone").collect()}
    assert marked["old-version"] == "gone" and marked["error"] == "gone" and marked["failed-done"] == "bad" and marked["done"] is None


def test_matching(log):
    assert {r["request_id"] for r in requestlog.matching(log, {"request_hash": "g", "error": None}).collect()} == {"old-version"}
    assert requestlog.matching(log, {}).count() == 11


def test_durations(spark):
    rows = [(0, "csv", 2.0), (499, "csv", 4.0), (499, "loom", 6.0), (500, "csv", 8.0)]
    rolled = requestlog.duration_rollup(spark.createDataFrame(rows, "num_bundles int, format string, duration double"))
    assert sorted(map(str, (tuple(r) for r in rolled.collect()))) == sorted(
        map(
            str,
            [
                ("0-499", "csv", 0, 2, 3.0),
                ("0-499", "loom", 0, 1, 6.0),
                ("500-999", "csv", 0, 1, 8.0),
                ("0-499", None, 1, 3, 4.0),
                ("500-999", None, 1, 1, 8.0),
            ],
        )
    )


def test_text_forms(spark):
    frame = spark.createDataFrame([(True, 1499), (False, 500), (None, 0)], "flag boolean, n int")
    found = frame.select(text.short_boolean(F.col("flag")), text.long_boolean(F.col("flag")), text.bundle_interval(F.col("n"))).collect()
    assert list(map(tuple, found)) == [("t", "True", "1000-1499"), ("f", "False", "500-999"), ("", "", "0-499")]
    stamp = "2019-05-14T122736.345001Z"
    moment = F.lit(stamp)
    assert spark.range(1).select(text.format_timestamp(text.parse_timestamp(moment))).first()[0] == stamp
    line = text.delimited(F.lit("a"), F.lit(None), F.lit(3))
    assert spark.range(1).select(line).first()[0] == "a||3"
