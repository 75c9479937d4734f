import numpy as np
import pytest

from cellframe.llm.topk import top_k
from conftest_llm import SF, rows


def by_hand(vectors, queries, k, scale=64):
    def good(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    whole = {i: np.floor(scale * np.array(v, float)) for i, v in vectors if i is not None and good(v)}
    out = []
    for q in sorted({i for i, v in queries if i is not None and good(v)}):
        scored = sorted((-int(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("slices, blocks", [(1, 64), (2, 7), (3, 20)])
def test_equals_brute_force_with_ties_and_bad_vectors(spark, slices, blocks):
    random = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in random.integers(-3, 3, 6) / 64]) for i in range(120)]
    vectors += [(200 + i, [0.02] * 6) for i in range(40)]
    vectors += [(300, None), (301, [None, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (305, [0.5]), (None, [0.1] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank", "3 as block")
    queries = frame.filter("vec_id % 20 = 0 or vec_id > 295")
    found = top_k(frame, queries, k=5, slices=slices, query_block=6, candidate_block=blocks)
    expected = by_hand(vectors, [v for v in vectors if v[0] is not None and (v[0] % 20 == 0 or v[0] > 295)], 5)
    assert sorted(map(tuple, found.collect())) == expected


def test_fewer_candidates_than_k_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert len(rows(top_k(frame, frame, k=20))) == 6
    assert top_k(frame.limit(0), frame, k=3).count() == 0
    assert top_k(frame, frame.limit(0), k=3).count() == 0


def test_an_id_of_a_third_of_all_rows(spark):
    vectors = [(7 if i % 3 == 0 else i, [float(i % 11) / 64, float(i % 7) / 64]) for i in range(300)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = frame.filter("vec_id in (1, 7)")
    found = top_k(frame.repartition(5), queries, k=30, query_block=4, candidate_block=8)
    own = [int(64 * x) for x in dict(vectors)[1]]
    scored = sorted((-sum(a * int(64 * x) for a, x in zip(own, v)), i) for i, v in vectors if i != 1)[:30]
    assert [(r["vec_id"], r["score"]) for r in sorted(found.filter("query_id = 1").collect(), key=lambda r: r["rank"])] == [(i, -s) for s, i in scored]
    assert found.filter("query_id = 7").count() == 30


def test_scores_beyond_whole_doubles_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e12]), (2, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        top_k(frame, frame)


def test_query_equals_sql(spark):
    import check_queries

    assert check_queries.compare(spark, check_queries.connect(SF), SF, "op6_threshold_top_k")[0] == "ok"
