import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellframe.llm.sharding import op9_sampled_shards, shard_by_size, write_shards
from conftest_llm import SF, rows


def assert_gapless(found, shards):
    for s in range(shards):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_hot_key_is_split_and_other_groups_stay_whole(spark):
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500)
    frame = spark.range(6000).select("id", F.xxhash64(hot).alias("key"), (F.col("id") % 90 + 1).alias("size"), F.xxhash64("id").alias("tie"))
    found = rows(shard_by_size(frame, "key", "size", "tie", 4))
    assert len(found) == 6000
    assert_gapless(found, 4)
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(4)]
    assert max(sizes) < 1.02 * min(sizes)
    groups = {}
    for r in found:
        groups.setdefault(r["key"], set()).add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 1


@pytest.mark.parametrize("size", [0, 1, 5])
def test_few_rows_and_extreme_keys(spark, size):
    keys = [-(1 << 63), (1 << 63) - 1, 0, 0, 0][:size]
    frame = spark.createDataFrame([(k, 1, n, "x") for n, k in enumerate(keys)], "key long, size long, tie long, shard string")
    found = rows(shard_by_size(frame, "key", "size", "tie", 3))
    assert len(found) == size
    assert_gapless(found, 3)


def test_repeated_rows(spark):
    frame = spark.createDataFrame([(5, 3, 5)] * 40, "key long, size long, tie long")
    assert_gapless(rows(shard_by_size(frame, "key", "size", "tie", 4)), 4)


def test_a_repeated_row_that_holds_a_third_of_the_table(spark):
    hot = F.col("id") % 3 == 0
    frame = spark.range(9000).select(
        F.col("id").alias("row"), F.when(hot, 7).otherwise(F.xxhash64("id")).alias("key"), F.when(hot, 50).otherwise(F.col("id") % 90 + 1).alias("size"), F.when(hot, 9).otherwise(F.xxhash64("id", F.lit(1))).alias("tie")
    )
    found = rows(shard_by_size(frame, "key", "size", "tie", 4, number="row"))
    assert len(found) == 9000
    assert_gapless(found, 4)
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(4)]
    assert max(sizes) < 1.05 * min(sizes)


def test_query_equals_counting(spark, documents):
    """Sizes, sums, law and growth of every document; equal texts lie together unless they are over twice a range's share."""
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    found = {r["doc_id"]: r for r in rows(op9_sampled_shards(spark, SF))}
    assert set(found) == set(texts)
    lie = {}
    for i, text in texts.items():
        data = text.encode()
        assert (found[i]["size"], found[i]["text_crc32"], found[i]["law"], found[i]["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        lie.setdefault(text, set()).add(found[i]["shard"])
    share = sum(r["size"] for r in found.values()) / (8 * 128)
    held = Counter(texts.values())
    assert all(len(s) == 1 or held[t] > 1 and held[t] * (len(t.encode()) + 1) > share for t, s in lie.items())


def test_query_and_files(spark, documents, tmp_path):
    found = op9_sampled_shards(spark, SF)
    listed = rows(found)
    assert_gapless(listed, 8)
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in documents.collect()}
    assert {r["doc_id"]: r["size"] for r in listed} == sizes
    totals = [sum(r["size"] for r in listed if r["shard"] == s) for s in range(8)]
    assert max(totals) - min(totals) <= 2 * max(sizes.values())
    write_shards(found.select("doc_id", "shard", "slot"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(sizes)
