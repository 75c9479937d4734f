import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cellframe.llm.quality import FEATURES, fit_quality, fit_trees, op7_quality_trees, statistics, with_quality
from conftest_llm import SF, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é中", "#x", " ", "\n", "\x0b", "\x1c", " ", "a b a b a", "1"]), max_size=40).map(" ".join))
def test_statistics_equal_plain_counting(text):
    assert statistics(text)[0] == by_hand(text)


def test_null_and_empty():
    assert statistics(None) == statistics("") == ([0] * 5, [0.0] * len(FEATURES))


def test_constraints_hold_everywhere():
    random = np.random.default_rng(2)
    x = random.random((3000, 3))
    good = (x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.3 * random.random(3000) > 0.7).astype(float)
    trees = fit_trees(x, good, [1, 0, -1], trees=30)
    assert ((trees.scores(x) > 0.5) == good).mean() > 0.9
    for feature, direction in ((0, 1), (2, -1)):
        line = np.repeat(random.random((1, 50, 3)), 40, axis=0)
        line[:, :, feature] = np.linspace(-0.5, 1.5, 40)[:, None]
        steps = np.diff(trees.scores(line.reshape(-1, 3)).reshape(40, 50), axis=0)
        assert (direction * steps >= -1e-12).all()


@pytest.mark.parametrize("good", [[], [1.0, 1.0, 1.0]])
def test_nothing_to_learn(good):
    trees = fit_trees(np.zeros((len(good), 3)), np.array(good), [0, 0, 0])
    assert np.ptp(trees.scores(np.random.default_rng(0).random((9, 3)))) == 0


def test_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    trees = fit_quality(odd_documents, labels)
    found = rows(with_quality(odd_documents, trees))
    assert len(found) == odd_documents.count() and {"taken", "fp"} <= set(found[0])
    for r in found:
        counted = by_hand(r["text"])
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == counted
        assert r["base_failed"] == (counted[0] < 50 or 100 * counted[4] > 50 * counted[0]) and not (r["base_failed"] and r["kept"])
    assert with_quality(odd_documents, trees, prefix="q!").first()["score"] == "x"
    assert with_quality(odd_documents.limit(0), fit_quality(odd_documents, labels.limit(0))).count() == 0


def test_junk_goes_and_clean_documents_stay(spark, documents):
    found = {r["doc_id"]: r for r in op7_quality_trees(spark, SF).collect()}
    assert len(found) == documents.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[i], r["kept"]) for i, r in found.items() if i in labels and not r["base_failed"]]
    assert sum(bool(good) == kept for good, kept in judged) / len(judged) > 0.97


def test_query_equals_counting(spark, documents):
    """Counts and base rules of every document by hand; the rest of the verdict by walking the trees node by node."""
    trees = fit_quality(documents, spark.read.parquet(f"{SF}/labels.parquet"))

    def walked(features):
        total = trees.base
        for root in trees.roots:
            node = int(root)
            while trees.left[node] != node:
                node = int(trees.left[node] if features[int(trees.feature[node])] <= trees.cut[node] else trees.right[node])
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    found = {r["doc_id"]: r for r in op7_quality_trees(spark, SF).collect()}
    for r in documents.collect():
        row, counted = found[r["doc_id"]], by_hand(r["text"])
        assert [row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == counted
        failed = counted[0] < 50 or 100 * counted[4] > 50 * counted[0]
        score = walked(statistics(r["text"])[1])
        assert row["score"] == pytest.approx(score) and row["base_failed"] == failed
        assert row["kept"] == (not failed and row["score"] >= 0.5)


def test_drawn_rows_agree_where_ids_repeat(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    twice = documents.unionByName(documents.withColumn("text", F.concat("text", F.lit(" more words"))))
    first, second = (fit_quality(d, labels, most_rows=60) for d in (twice, twice.repartition(7)))
    assert (first.cut == second.cut).all() and (first.value == second.value).all()


def test_without_usable_labels_the_base_rules_decide(spark, documents):
    kind = "doc_id long, quality int"
    first = documents.first()["doc_id"]
    for labels in ([], [(first, None), (None, 1)], [(-5, 1), (-6, 0)]):
        trees = fit_quality(documents, spark.createDataFrame(labels, kind))
        found = rows(with_quality(documents, trees, keep=["doc_id"]))
        assert all(r["kept"] != r["base_failed"] for r in found) and any(r["kept"] for r in found)


def test_labels_of_no_document_leave_room_for_the_others(spark, documents):
    usable = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").filter("quality is not null")
    strange = spark.range(10**12, 10**12 + 2000).selectExpr("id as doc_id", "1 as quality")
    alone, among = (fit_quality(documents, f, most_rows=200) for f in (usable, usable.unionByName(strange)))
    assert (alone.cut == among.cut).all() and (alone.value == among.value).all()
