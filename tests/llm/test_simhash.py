import re

import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cellframe.llm.simhash import components, deduplicated, fingerprint, links, op8_simhash_groups, with_components, with_fingerprint
from conftest_llm import SF, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["Aa", "É", "x", "\t", "中", "b", "c d e", "\x1c"]), max_size=25).map(" ".join))
def test_fingerprints_equal_plain_counting(text):
    assert fingerprint(text) % (1 << 64) == by_hand(text)


def groups(prints, radius=4):
    """Smallest id reachable, by comparing all pairs."""
    parent = {p: p for p in set(prints.values())}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    known = list(parent)
    for n, a in enumerate(known):
        for b in known[:n]:
            if bin((a ^ b) % (1 << 64)).count("1") <= radius:
                parent[find(a)] = find(b)
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(find(p), i)
    return {i: least[find(p)] for i, p in prints.items()}


@pytest.mark.parametrize("segments, radius", [(1, 2), (2, 4), (3, 4), (4, 4), (5, 3), (3, 0)])
def test_links_equal_all_pairs(spark, segments, radius):
    import random

    random.seed(segments)
    centers = [random.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = {c ^ sum(1 << b for b in random.sample(range(64), random.randrange(7))) for c in centers for _ in range(12)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, segments).collect()
    expected = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= radius]
    assert sorted(map(tuple, found)) == expected


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 70)] + [(1000, 1000 + i) for i in range(1, 300)] + [(-5, 2000), (1999, 2000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(71)}, **{1000 + i: 1000 for i in range(300)}, -5: -5, 2000: -5, 1999: -5}


def test_odd_documents(spark, odd_documents):
    found = rows(with_components(with_fingerprint(odd_documents.withColumn("component_id", F.lit("x")))))
    assert set(found[0]) == {*odd_documents.columns, "component_id"}
    assert len(found) == odd_documents.count()
    empty = [r["component_id"] for r in found if not (r["text"] or "").strip()]
    assert set(empty) == {1}
    kept = rows(deduplicated(odd_documents))
    assert len(kept) == len({r["root"] for r in found}) and set(kept[0]) == set(odd_documents.columns)
    assert sum(r["doc_id"] == 4 for r in kept) == 1 and not any(r["doc_id"] == 5 for r in kept)
    none = odd_documents.limit(0)
    assert with_components(with_fingerprint(none.select("doc_id", "text"))).count() == 0 and deduplicated(none).count() == 0


def test_a_hot_group_of_copies(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two three four five").otherwise(F.md5(F.col("id").cast("string"))).alias("text"))
    found = rows(with_components(with_fingerprint(frame)))
    assert {r["component_id"] for r in found if r["doc_id"] % 3} == {1}
    assert deduplicated(frame).count() == len({r["component_id"] for r in found})


def test_query_equals_all_pairs(spark, documents):
    prints = {r["doc_id"]: by_hand(r["text"]) for r in documents.collect()}
    expected = groups(prints)
    found = op8_simhash_groups(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{p:016x}", expected[i]) for i, p in prints.items()}
