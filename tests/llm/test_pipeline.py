from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from cellframe.llm.frames import word_count
from cellframe.llm.mixing import source_targets
from cellframe.llm.quality import fit_quality, statistics
from cellframe.llm.simhash import fingerprint
from cellframe.session import durable
from conftest_llm import SF, rows
from test_simhash import groups


@pytest.fixture(scope="module")
def steps(spark, documents):
    found = [documents]
    for name, stage in corpus_pipeline.STAGES:
        found.append(durable(stage(spark, found[-1], SF), name))
    return found


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixture", "packing"]
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_stages_before_the_last_return_documents(steps, documents):
    assert all(s.schema.names == documents.schema.names for s in steps[:-1])


def test_quality_keeps_what_its_rules_keep(spark, steps, documents):
    trees = fit_quality(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = set()
    for r in documents.collect():
        counted, features = statistics(r["text"])
        good = counted[0] >= 50 and 100 * counted[4] <= 50 * counted[0]
        if good and trees.scores(__import__("numpy").array([features]))[0] >= 0.5:
            expected.add(r["doc_id"])
    assert {r["doc_id"] for r in steps[1].collect()} == expected


def test_language_keeps_labelled_documents(steps):
    before = steps[1].count()
    assert before * 0.99 <= steps[2].count() <= before


def test_one_document_of_each_group_stays(steps):
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in steps[2].collect()}
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(set(groups(prints).values()))


def test_mixture_takes_near_its_share(steps):
    """A source has one shard here, so it is off its target by half of its longest document and a block at most."""
    sized = steps[3].withColumn("size", word_count(F.col("text")))
    before = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest")).collect()}
    targets = {r["source"]: r["target"] for r in source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source", (5, 2, 1), 1.5).collect()}
    after = {r["source"]: r["w"] for r in steps[4].groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("w")).collect()}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(r["source_size"] for r in before.values()))
    for s, r in before.items():
        assert abs(after.get(s, 0) - targets[s]) <= r["longest"] / 2 + 16
        assert after.get(s, 0) <= 2 * r["source_size"]
    assert max(Counter(r["doc_id"] for r in steps[4].collect()).values()) == 2


def test_packing_holds_all_of_the_mixture(steps):
    packed = rows(steps[5].drop("ids"))
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in steps[4].collect())
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert all(n == 2048 for s, n in filled.items() if s < max(filled))


def test_odd_documents(spark, odd_documents, tmp_path):
    columns = odd_documents.columns
    docs = odd_documents
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = durable(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert stage is not None and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
