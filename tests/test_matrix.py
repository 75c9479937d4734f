import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellframe.operators import reshape
from cellframe.operators.metrics import matrix_metrics, metrics_agree


def make(spark, cells=200, features=37, seed=1, zero_share=0.2):
    """Random sparse values as ``{(cell, feature): value}`` and as a frame."""
    rng = random.Random(seed)
    values = {}
    for c in range(cells):
        for f in rng.sample(range(features), rng.randint(0, 9)):
            values[f"cell{c:05d}", f"G{f:03d}"] = 0.0 if rng.random() < zero_share else float(rng.randint(1, 9999))
    rows = [(c, f, v) for (c, f), v in values.items()]
    rng.shuffle(rows)
    axis = spark.createDataFrame([(f"G{f:03d}",) for f in range(features)], "featurekey string")
    return values, spark.createDataFrame(rows, "cellkey string, featurekey string, exprvalue float"), axis


def test_ordinals_are_places_in_ascending_order(spark):
    keys = [f"k{i * 7919 % 15000:05d}" for i in range(15000)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    found = {r["key"]: r["ordinal"] for r in reshape.ordinals(frame.union(frame), "key").collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys), 1)}
    assert reshape.ordinals(frame.limit(0), "key").count() == 0


def test_a_small_axis_is_broadcast_and_nothing_is_sorted_in_one_task(spark):
    frame = spark.range(10000).select(F.col("id").cast("string").alias("featurekey"))
    axis = reshape.ordinals(frame, "featurekey")
    plan = axis._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    values = spark.range(1000).select(F.col("id").cast("string").alias("featurekey"))
    joined = values.join(axis, "featurekey")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined and "Exchange hashpartitioning" not in joined


def test_coordinates_against_brute_force(spark):
    values, frame, axis = make(spark)
    some = axis.filter("featurekey != 'G005'")
    features = reshape.ordinals(some, "featurekey")
    cells = reshape.ordinals(frame.select("cellkey"), "cellkey")
    rows = {f: i for i, f in enumerate(sorted(r[0] for r in some.collect()), 1)}
    columns = {c: i for i, c in enumerate(sorted({c for c, _ in values}), 1)}
    expected = {(rows[f], columns[c]): v for (c, f), v in values.items() if v and f in rows}
    found = reshape.coordinates(frame, features, cells).collect()
    assert {(r["row"], r["col"]): r["value"] for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("seed", range(3))
def test_dense_and_sparse_rows_against_brute_force(spark, seed):
    values, frame, axis = make(spark, cells=60, features=11, seed=seed)
    some = axis.filter("featurekey NOT IN ('G000', 'G010')")
    names = sorted(r[0] for r in some.collect())
    features = reshape.ordinals(some, "featurekey")
    expected = {c: [values.get((c, f), 0.0) for f in names] for c, _ in values}
    dense = {r["cellkey"]: r["values"] for r in reshape.dense_rows(frame, features, len(names)).collect()}
    assert dense == expected
    lines = {r["cellkey"]: r["line"] for r in reshape.dense_lines(frame, features, len(names)).collect()}
    assert {c: [float(x) for x in line.split(",")[1:]] for c, line in lines.items()} == expected
    sparse = reshape.sparse_rows(frame, features).collect()
    assert {r["cellkey"]: dict(zip(r["indices"], r["values"])) for r in sparse} == {
        c: {i: v for i, v in enumerate(row, 1) if v} for c, row in expected.items()
    }
    assert all(r["indices"] == sorted(r["indices"]) for r in sparse)


def test_a_cell_without_listed_features_is_a_row_of_zeros(spark):
    frame = spark.createDataFrame([("c", "GX", 1.0)], "cellkey string, featurekey string, exprvalue float")
    features = reshape.ordinals(spark.createDataFrame([("G1",), ("G2",)], "featurekey string"), "featurekey")
    assert reshape.dense_rows(frame, features, 2).first()["values"] == [0.0, 0.0]
    assert reshape.dense_lines(frame, features, 2).first()["line"] == "c,0,0"
    assert reshape.sparse_rows(frame, features).first()["indices"] == []


def test_duplicates_fail_or_are_summed(spark):
    rows = [("c", "G1", 1.5), ("c", "G1", 2.0), ("c", "G2", 4.0)]
    frame = spark.createDataFrame(rows, "cellkey string, featurekey string, exprvalue float")
    assert [tuple(r) for r in reshape.duplicates(frame).collect()] == [("c", "G1", 2)]
    with pytest.raises(PySparkException, match="more than one value for c / G1"):
        reshape.one_per_pair(frame).collect()
    summed = {r["featurekey"]: r["exprvalue"] for r in reshape.one_per_pair(frame, "sum").collect()}
    assert summed == {"G1": 3.5, "G2": 4.0}
    with pytest.raises(ValueError):
        reshape.one_per_pair(frame, "first")


def test_one_cell_with_a_third_of_all_rows(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") < 10000, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("cellkey"),
        F.when(F.col("id") < 10000, F.col("id") / 500).otherwise(F.lit(1)).cast("int").cast("string").alias("featurekey"),
        F.lit(1.0).alias("exprvalue"),
    )
    features = reshape.ordinals(rows.select("featurekey"), "featurekey")
    hot = reshape.dense_rows(rows, features, 20, "sum").filter("cellkey = 'hot'").first()
    assert hot["values"] == [500.0] * 20
    assert tuple(matrix_metrics(rows).first()) == (30000.0, 30000, 20001)


def test_dense_to_long_and_back(spark):
    rows = [("b1", "c1", [0.0, 1.0, 2.5]), ("b1", "c2", [0.0, 0.0, 0.0]), ("b2", "c3", [4.0, 0.0, 5.0])]
    frame = spark.createDataFrame(rows, "bundle_fqid string, cell string, values array<float>")
    axis = spark.createDataFrame(
        [("b1", 0, "A"), ("b1", 1, "B"), ("b1", 2, "C"), ("b2", 0, "C"), ("b2", 1, "A"), ("b2", 2, "B")],
        "bundle_fqid string, position int, gene string",
    )
    found = reshape.dense_to_long(frame, axis, ("bundle_fqid",)).select("cell", "gene", "exprvalue").collect()
    assert sorted(map(tuple, found)) == [("c1", "B", 1.0), ("c1", "C", 2.5), ("c3", "B", 5.0), ("c3", "C", 4.0)]
    counts = {r["cell"]: r["n"] for r in frame.select("cell", reshape.nonzero_count(F.col("values")).alias("n")).collect()}
    assert counts == {"c1": 2, "c2": 0, "c3": 2}


def test_cells_with_and_without_values(spark, snowflake):
    cells, values = snowflake["cell"], snowflake["expression"]
    assert sorted(r[0] for r in reshape.cells_with_values(cells, values).collect()) == ["c1", "c2", "c3", "c4", "c5", "c6"]
    assert [r[0] for r in reshape.cells_without_values(cells, values).collect()] == ["c7"]


def test_metrics_agree_within_tolerance(spark):
    frame = spark.createDataFrame([("a", 100000.0), ("b", 0.0)], "cellkey string, exprvalue double")
    near = frame.withColumn("exprvalue", F.col("exprvalue") * 1.000001)
    far = frame.withColumn("exprvalue", F.col("exprvalue") * 1.01)
    assert metrics_agree(matrix_metrics(frame), matrix_metrics(near))
    assert not metrics_agree(matrix_metrics(frame), matrix_metrics(far))
    assert not metrics_agree(matrix_metrics(frame), matrix_metrics(frame.filter("exprvalue > 0")))
