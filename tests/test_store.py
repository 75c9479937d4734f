import glob
import json
import os

import pytest
from pyspark.sql import functions as F

import bundle_files as files
from cellframe import fixed
from cellframe.catalog import CELL_CATALOG
from cellframe.operators.keyed import concat, latest, ordered_distinct, remove, upsert
from cellframe.plans import audits
from cellframe.plans.ingest import empty_tables, ingest_bundles
from cellframe.plans.store import Store, UnknownVersion
from cellframe.sources.bundles import read_bundles
from cellframe.streaming.notifications import (
    NotificationHandler,
    decide,
    read_notifications,
    route,
    start_notifications,
)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(files.LABELS, "term string, label string")


def bundle_counts(store):
    rows = audits.bundle_counts(CELL_CATALOG, store.tables()).collect()
    return {r["bundle"]: (r["analyses"], r["cells"], r["values"]) for r in rows}


def test_upsert_and_remove_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (4, "y"), (4, "z")], "k int, v string")
    once = upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "x"), (3, "d"), (4, "y"), (4, "z")]
    assert sorted(map(tuple, upsert(once, new, "k").collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, remove(old, new, "k").collect())) == [(1, "a"), (3, "d")]


def test_latest_and_ordered_distinct(spark):
    rows = [("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", 1, "w")]
    frame = spark.createDataFrame(rows, "k string, seq int, v string")
    assert sorted(map(tuple, latest(frame, "k", "seq").collect())) == [("a", 3, None), ("b", 1, "w")]
    places = {r["k"]: r["first_place"] for r in ordered_distinct(frame, "k", F.col("seq")).collect()}
    assert places == {"a": 1, "b": 1}
    assert concat(frame, frame, frame).count() == 12


def test_versions(spark, snowflake, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    assert store.current() == 0 and store.read("cell").isEmpty()
    assert store.create() == 1
    assert all(frame.isEmpty() for frame in store.tables().values())
    assert store.reload(snowflake) == 2
    for name, frame in store.tables().items():
        assert sorted(map(str, frame.select(*snowflake[name].columns).collect())) == sorted(map(str, snowflake[name].collect()))
    # A reload replaces what was there, it does not append.
    assert store.reload({"cell": snowflake["cell"].limit(2)}) == 3
    assert store.read("cell").count() == 2 and store.read("donor").isEmpty()
    store.set_version(2)
    assert store.current() == 2 and store.read("cell").count() == 7
    with pytest.raises(UnknownVersion):
        store.set_version(9)
    assert store.bump() == 4 and store.read("cell").count() == 7
    assert [r["version"] for r in store.data_versions().orderBy("version").collect()] == [1, 2, 3, 4]
    per_project = store.project_cells().filter("version = 4").collect()
    assert {r["projectkey"]: r["cells"] for r in per_project} == {"p1": 5, "p2": 2}
    expected = spark.createDataFrame([("b1.2019.1",), ("b9.1",)], "bundle string")
    assert [r[0] for r in store.verify(expected).collect()] == ["b9.1"]


@pytest.mark.parametrize("copies, placed", [(1, True), (2, False)])
def test_values_that_stay_do_not_meet_their_cells_again(spark, tmp_path, monkeypatch, copies, placed):
    cells = spark.createDataFrame([(f"c{i}", f"a{i % 5}") for i in range(20)] * copies, "cellkey string, analysiskey string")
    values = [(f"c{i}" if i < 20 else None, f"f{j}", "Count", float(i)) for i in range(21) for j in range(3)]
    values = spark.createDataFrame(values, "cellkey string, featurekey string, exprtype string, exrpvalue float")
    analyses = spark.createDataFrame([(f"a{i}", f"b{i}.1") for i in range(5)], "analysiskey string, bundle_fqid string")
    empty = empty_tables(spark)
    tables = {"cell": cells, "analysis": analyses, "expression": values}
    tables = {n: t.withColumns({f.name: F.lit(None).cast(f.dataType) for f in empty[n].schema if f.name not in t.columns}).select(*empty[n].columns) for n, t in tables.items()}
    store = Store(spark, str(tmp_path), buckets=4)
    store.reload(tables)
    given, write = [], Store._write
    monkeypatch.setattr(Store, "_write", lambda self, name, rows, *rest: given.append((name, "bucket" in rows.columns)) or write(self, name, rows, *rest))
    # a value of a new cell, of one that isn't there and of one that is
    new = spark.createDataFrame([("c3", "n", "Count", 7.0), ("c99", "n", "Count", 8.0)], tables["expression"].schema)
    store.upsert({"expression": new})
    store.remove(spark.createDataFrame([("b1.1",)], "bundle_fqid string"))
    assert [p for n, p in given if n == "expression"] == [placed, placed]
    kept = {tuple(r) for r in values.collect() if r[0] is None or (r[0] != "c3" and int(r[0][1:]) % 5 != 1)} | {("c3", "n", "Count", 7.0), ("c99", "n", "Count", 8.0)}
    found = store.tables()["expression"]
    rows = [tuple(r) for r in found.drop(fixed.BUCKET).collect()]
    assert set(rows) == kept and (copies > 1 or len(rows) == len(kept))
    # every value lies where its cell does
    lies = found.join(store.tables()["cell"].select("cellkey", F.col(fixed.BUCKET).alias("own")), "cellkey", "left")
    assert lies.filter(F.col(fixed.BUCKET) != F.coalesce("own", F.lit(fixed.NO_BUCKET))).isEmpty()


def test_upsert_rewrites_only_touched_buckets(spark, snowflake, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    store.reload(snowflake)
    changed = snowflake["expression"].filter("cellkey = 'c2'").withColumn("exrpvalue", F.lit(0.5).cast("float"))
    feature = snowflake["feature"].limit(1)
    version = store.upsert({"expression": changed, "feature": feature})
    values = {(r["cellkey"], r["featurekey"]): r["exrpvalue"] for r in store.read("expression").collect() if r["cellkey"] == "c2"}
    assert values == {("c2", "G1"): 0.5, ("c2", "G3"): 0.5}
    assert store.read("expression").count() == 11 and store.read("feature").count() == 5
    assert len(glob.glob(f"{tmp_path}/tables/expression/v={version}/bucket=*")) == 1
    assert not os.path.exists(f"{tmp_path}/tables/cell/v={version}")
    # Applying it again changes nothing.
    before = sorted(map(str, store.read("expression").collect()))
    store.upsert({"expression": changed})
    assert sorted(map(str, store.read("expression").collect())) == before
    # The earlier version is still whole.
    assert sorted(map(str, store.read("expression", 1).collect())) == sorted(map(str, snowflake["expression"].collect()))


def test_remove_bundles(spark, snowflake, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    store.reload(snowflake)
    store.remove(spark.createDataFrame([("b1.2019.1",), ("none.1",)], "bundle_fqid string"))
    assert sorted(r["cellkey"] for r in store.read("cell").collect()) == ["c3", "c4", "c5", "c6"]
    assert {r["cellkey"] for r in store.read("expression").collect()} == {"c3", "c4", "c5", "c6"}
    assert [r["bundle_uuid"] for r in store.read("analysis").collect()] == ["b2"]
    assert store.read("donor").count() == 2
    lost = audits.orphans(store.read("cell_suspension"), "cellsuspensionkey", store.read("cell"), "cellsuspensionkey")
    assert [r["cellsuspensionkey"] for r in lost.collect()] == ["s3"]
    store.remove(spark.createDataFrame([("b2.2019.1",)], "bundle_fqid string"))
    assert store.read("analysis").isEmpty() and {r[0] for r in store.read("cell").select("cellkey").collect()} == {"c6"}


def note(folder, seq, bundle, kind):
    uuid, version = bundle.split(".", 1)
    with open(f"{folder}/{seq:04d}.json", "w") as file:
        json.dump({"bundle_uuid": uuid, "bundle_version": version, "event_type": kind, "seq": seq}, file)


def test_routing(spark):
    rows = [
        ("u1", "1", "CREATE", 1), ("u1", "1", "DELETE", 3), ("u1", "1", "nonsense", 4), ("u2", "1", "TOMBSTONE", 1),
        ("u2", "1", "UPDATE", 2), (None, "1", "CREATE", 5), ("u3", "1", None, 6),
    ]
    routed = route(spark.createDataFrame(rows, "bundle_uuid string, bundle_version string, event_type string, seq long"))
    assert sorted(r["action"] for r in routed.collect()) == ["invalid"] * 3 + ["remove"] * 2 + ["upsert"] * 2
    assert {r["bundle_fqid"]: r["action"] for r in decide(routed).collect()} == {"u1.1": "remove", "u2.1": "upsert"}


def test_round_trip_of_notifications(spark, labels, tmp_path):
    landing, inbox = tmp_path / "landing", tmp_path / "inbox"
    inbox.mkdir()
    files.write_plate(landing)
    files.write_droplet(landing)
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    tables, _ = ingest_bundles(read_bundles(spark, str(landing)), labels)
    store.reload(tables)
    plate, droplet = files.PLATE.split(".")[0], files.DROPLET.split(".")[0]
    full = {plate: (1, 1, 6), droplet: (1, 2, 4)}
    assert bundle_counts(store) == full
    handler = NotificationHandler(store, lambda updates: read_bundles(spark, str(landing)).restrict(updates), labels, str(tmp_path / "quarantine"))

    def deliver():
        stream = read_notifications(spark, str(inbox))
        start_notifications(stream, handler, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()

    note(inbox, 1, files.PLATE, "DELETE")
    deliver()
    assert bundle_counts(store) == {droplet: full[droplet]}
    note(inbox, 2, files.PLATE, "CREATE")
    note(inbox, 3, "unknown.1", "CREATE")
    note(inbox, 4, files.DROPLET, "RENAME")
    deliver()
    assert bundle_counts(store) == full
    rejected = {(r["entity"], r["reason"]) for r in spark.read.json(str(tmp_path / "quarantine")).collect()}
    assert rejected == {("unknown.1", "not in the landing zone"), (files.DROPLET, "invalid event type RENAME")}
    note(inbox, 5, files.PLATE, "TOMBSTONE")
    note(inbox, 6, files.DROPLET, "TOMBSTONE")
    deliver()
    assert bundle_counts(store) == {}
    note(inbox, 7, files.DROPLET, "DELETE")
    note(inbox, 8, files.DROPLET, "UPDATE")
    deliver()
    assert bundle_counts(store) == {droplet: full[droplet]}

    # A batch that comes again is skipped; the same number of another stream is not.
    version = store.current()
    batch = spark.createDataFrame([(droplet, files.DROPLET.split(".", 1)[1], "DELETE", 9)], "bundle_uuid string, bundle_version string, event_type string, seq long")
    with open(tmp_path / "checkpoint" / "metadata") as file:
        stream = json.load(file)["id"]
    handler(batch, 3, stream)
    assert store.current() == version
    handler(batch, 3, "another")
    assert bundle_counts(store) == {}


def test_an_update_replaces_the_values_of_a_cell(spark, labels, tmp_path):
    landing = tmp_path / "landing"
    files.write_plate(landing)
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    store.reload(ingest_bundles(read_bundles(spark, str(landing)), labels)[0])
    files.write_plate(landing, counts=((1.0, 50.0), (2.0, 60.0)))
    store.upsert(ingest_bundles(read_bundles(spark, str(landing)), labels)[0])
    counted = store.read("expression").filter("featurekey = 'ENSG01' AND exprtype = 'Count'").collect()
    assert [r["exrpvalue"] for r in counted] == [110.0]
    assert store.read("contributor").count() == 2


def test_the_log_is_read_in_bounded_time(spark, snowflake, tmp_path):
    """Many versions in blocks of three: the current one, the next one and published batches come from the last block."""
    store = Store(spark, str(tmp_path), buckets=2, log_block=3)
    store.create()
    for n in range(7):
        store.apply({"project": snowflake["project"]}, None, "stream", n)
    assert store.current() == 8 and len(glob.glob(f"{tmp_path}/pointer/block=*")) == 3
    store.set_version(4)
    again = Store(spark, str(tmp_path), log_block=3)
    assert again.current() == 4 and again.bump() == 9 and again.current() == 9
    assert again.has_batch("stream", 0) and again.has_batch("stream", 6) and not again.has_batch("stream", 7) and not again.has_batch("other", 0)
    assert sorted(r["version"] for r in again.data_versions().collect()) == list(range(1, 10))
    assert len(again._pointer.recent().inputFiles()) <= 4 and again._pointer._blocks() == len(glob.glob(f"{tmp_path}/pointer/block=*"))
    assert again.read("project", 3).count() == 2
