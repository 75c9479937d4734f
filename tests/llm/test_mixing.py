import pytest
from pyspark.sql import functions as F

from cellframe.llm.frames import word_count
from cellframe.llm.mixing import apportion, mix, mixed_documents, source_targets
from conftest_llm import SF, rows


def highest(votes, seats, caps):
    """Seats by ranking every quotient."""
    quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes.items() for k in range(caps[p])))[:seats]
    return {p: sum(q == p for _, q in quotients) for p in votes}


@pytest.mark.parametrize("seats", [0, 1, 3, 10, 57, 1000])
def test_apportionment_equals_ranked_quotients(spark, seats):
    votes = {1: 53.0, 2: 24.0, 3: 23.0, 4: 0.0, 5: 53.0, 6: 0.4, 7: 7.0}
    caps = dict.fromkeys(votes, 10_000)
    frame = spark.createDataFrame([("g", k, v, seats, caps[k]) for k, v in votes.items()], "g string, k int, v double, s long, c long")
    found = {r["k"]: r["q"] for r in apportion(frame, ["g"], "k", "v", "s", "c", "q").collect()}
    assert found == highest(votes, seats, caps) and sum(found.values()) == seats


def test_apportionment_keeps_to_caps(spark):
    frame = spark.createDataFrame([(1, 10.0, 8, 3), (2, 10.0, 8, 5)], "k int, v double, s long, c long")
    assert {r["k"]: r["q"] for r in apportion(frame, [], "k", "v", "s", "c", "q").collect()} == {1: 3, 2: 5}


@pytest.mark.parametrize("seats", [0, 1, 5, 20, 24, 39, 43, 60])
def test_capped_parties_leave_their_seats_to_the_others(spark, seats):
    """Caps that bind at any share of the votes, none at all among them."""
    votes = {1: 100.0, 2: 1.0, 3: 50.0, 4: 0.0, 5: 7.0, 6: 7.0}
    caps = {1: 3, 2: 17, 3: 0, 4: 9, 5: 20, 6: 3}
    frame = spark.createDataFrame([("g", k, v, seats, caps[k]) for k, v in votes.items()], "g string, k int, v double, s long, c long")
    found = {r["k"]: r["q"] for r in apportion(frame, ["g"], "k", "v", "s", "c", "q").collect()}
    assert found == highest({k: v for k, v in votes.items() if v} | {4: 0.0}, min(seats, 43), caps | {4: 0})


def test_rows_that_are_never_taken_form_no_group(spark):
    frame = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 > 0, F.col("id") % 9).otherwise(0).alias("size")
    )
    found = rows(mix(frame.repartition(4), (5, 2, 1), shard_words=100))
    assert len(found) == 900 and all(r["taken"] == 0 for r in found if not r["size"])
    assert sum(r["taken"] for r in found) == pytest.approx(1.5 * sum(r["size"] for r in found), abs=32)


def test_targets_stop_at_twice_their_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("B", 90), ("c", 0)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in source_targets(sizes, "source", (5, 2, 1), 1.5).collect()}
    left, weights, capped = 1.5 * 1600, {"B": 5, "a": 2, "b": 1, "c": 5, None: 2}, {}
    sizes = {"a": 10, "b": 1000, None: 500, "B": 90, "c": 0}
    while over := [s for s in weights if s not in capped and left / sum(w for t, w in weights.items() if t not in capped) * weights[s] > 2 * sizes[s]]:
        for s in over:
            capped[s] = 2.0 * sizes[s]
        left = 1.5 * 1600 - sum(capped.values())
    level = left / sum(w for t, w in weights.items() if t not in capped)
    assert found == pytest.approx({s: capped.get(s, level * weights[s]) for s in weights})


def test_odd_documents(spark, odd_documents):
    sized = odd_documents.withColumn("words", word_count(F.col("text")))
    found = rows(mix(sized, (5, 2, 1), size="words"))
    assert len(found) == odd_documents.count() and {"score", "fp", "kept"} <= set(found[0])
    assert all(0 <= r["taken"] <= 2 * r["words"] for r in found)
    kept = rows(mix(sized, (5, 2, 1), size="words", prefix="mix!"))
    assert {r["taken"] for r in kept} == {"x"} and sorted(r["mix!taken"] for r in kept) == sorted(r["taken"] for r in found)
    assert mix(sized.limit(0), (5, 2, 1), size="words").count() == 0


def test_shards_of_a_hot_source_come_near_their_target(spark):
    frame = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        (F.col("id") % 50).alias("size"),
    )
    found = mix(frame, (5, 2, 1), shard_words=500)
    sums = found.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 2 * F.col("size")).alias("m")).collect()
    assert all(abs(r["t"] - r["g"]) <= max(32, 0.01 * r["g"]) and r["m"] <= 0 for r in sums)
    assert sorted(map(str, found.collect())) == sorted(map(str, mix(frame.repartition(7), (5, 2, 1), shard_words=500).collect()))


def test_mixed_documents_hold_the_words_taken(spark, documents):
    sized = documents.withColumn("size", word_count(F.col("text")))
    mixed = mix(sized, (5, 2, 1))
    texts = mixed_documents(mixed)
    got = {r["source"]: r["w"] for r in texts.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("w")).collect()}
    expected = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("w")).collect() if r["w"]}
    assert got == expected
    assert texts.filter(~F.col("text").isin([r["text"] for r in documents.collect()])).join(documents.select("doc_id", F.col("text").alias("t")), "doc_id").filter(
        ~F.expr("startswith(t, text)")
    ).isEmpty()


def test_query_equals_sql(spark):
    import check_queries

    assert check_queries.compare(spark, check_queries.connect(SF), SF, "op2_mixture")[0] == "ok"


def test_the_stage_cuts_no_document(spark, documents):
    import corpus_pipeline

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    taken = corpus_pipeline.mixture(spark, documents, SF).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in taken)
    small = spark.createDataFrame([(1, 0, 3), (2, 0, 2), (3, 2, 1), (4, 1, 0), (5, 0, 4)], "doc_id long, copies long, part long").withColumn("size", F.lit(4)).withColumn("text", F.lit("a b c d"))
    assert sorted(r["doc_id"] for r in mixed_documents(small, whole=True).collect()) == [1, 2, 3, 3, 4, 5]
