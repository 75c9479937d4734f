import random

import pytest
from pyspark.sql import functions as F

from cellframe.operators.prefix import group_ordinals, in_order, running, whole_blocks
from cellframe.sources.results import result_blocks, write_blocks


def test_running_totals_over_many_ranges(spark):
    rows = [(k, random.randrange(5)) for k in range(500)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "k int, n int").repartition(7)
    found = {r["k"]: (r["before"], r["rows"]) for r in running(in_order(frame, ["k"]), before=F.col("n"), rows=F.lit(1)).collect()}
    sizes = dict(rows)
    assert found == {k: (sum(sizes[j] for j in range(k)), k) for k in range(500)}
    assert running(in_order(frame.limit(0), ["k"]), before=F.col("n")).count() == 0


def test_ordinals_within_groups(spark):
    rows = [(g, k) for g in ("b", "a", None) for k in range(0, 90, 3)] + [("c", 5), ("c", 5)]
    found = group_ordinals(spark.createDataFrame(rows, "g string, k int").repartition(5), "g", "k").collect()
    expected = {(g, k): n + 1 for g in ("a", "b", None) for n, k in enumerate(range(0, 90, 3))} | {("c", 5): 1}
    assert {(r["g"], r["k"]): r["ordinal"] for r in found} == expected and len(found) == len(expected)


def blocks_by_hand(sizes, rows):
    """The rule, one cell after the other."""
    half, before, block, previous, out = max(1, rows // 2), 0, -1, None, {}
    for cell, n in sorted(sizes.items()):
        part = -1 if n > half else before // half
        block += n > half or previous is None or part != previous
        out[cell], previous, before = block, part, before + n
    return out


@pytest.mark.parametrize("rows", [1, 7, 20, 1000])
def test_blocks_hold_whole_cells(spark, rows):
    random.seed(rows)
    sizes = {cell: random.choice([1, 2, 3, 9, 25]) for cell in range(200)}
    values = spark.createDataFrame([(cell, n) for cell, n in sizes.items()], "cellkey int, n int").select("cellkey", F.explode(F.sequence(F.lit(1), "n")).alias("v"))
    found = {r["cellkey"]: r["block"] for r in whole_blocks(values.repartition(9), rows).collect()}
    assert found == blocks_by_hand(sizes, rows)
    filled = {}
    for cell, block in found.items():
        filled.setdefault(block, []).append(sizes[cell])
    assert sorted(filled) == list(range(len(filled)))
    assert all(sum(own) <= rows or len(own) == 1 for own in filled.values())
    whole = result_blocks(values, rows)
    assert whole.count() == sum(sizes.values()) and whole.columns == ["cellkey", "v", "block"]


def test_blocks_of_odd_values(spark, tmp_path):
    values = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6)], "cellkey string, v int")
    found = {(r["cellkey"], r["v"]): r["block"] for r in result_blocks(values, 4).collect()}
    assert found == {(None, 1): 0, (None, 2): 0, ("a", 3): 1, ("b", 4): 2, ("b", 5): 2, ("b", 6): 2}
    assert result_blocks(values.limit(0), 4).count() == 0
    write_blocks(values, str(tmp_path / "blocks"), 4)
    back = spark.read.parquet(str(tmp_path / "blocks"))
    assert {(r["cellkey"], r["v"]): r["block"] for r in back.collect()} == found
    files = back.select("block", F.col("_metadata.file_path").alias("f")).distinct().groupBy("block").count().collect()
    assert all(r["count"] == 1 for r in files)
