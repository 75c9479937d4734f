import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.llm.divergence import Trees, audit, groups_of, kept_counts, op11_source_divergence, pair_values, priced, term_counts, terms
from conftest_llm import SF, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, ranks=200):
    """Rows (lang, source, part, item, value, rank) by counting; ``docs`` are (lang, source, text)."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in docs]
    with_term = Counter((lang, t) for lang, _, found in docs for t in set(found))
    kept, counts = defaultdict(list), defaultdict(Counter)
    for (lang, t), n in with_term.items():
        if n >= 3:
            kept[lang].append(t)
    for lang, source, found in docs:
        counts[lang, source].update(t for t in found if with_term[lang, t] >= 3)
    out = []
    for (lang, source), count in counts.items():
        v = len(kept[lang])

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)

        whole = sum((c for (g, _), c in counts.items() if g == lang), Counter())
        price = lambda p, q: (p - q) ** 2 // q
        pairs = [(o, sum(price(share(count, t), share(c, t)) for t in kept[lang])) for (g, o), c in counts.items() if g == lang and o != source]
        more = [(t, price(share(count, t), share(whole, t))) for t in kept[lang] if count[t] and share(count, t) > share(whole, t)]
        for part, items in (("pair", pairs), ("term", more)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, n, k) for k, (i, n) in enumerate(items, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def found(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_trees_price_pairs_as_plain_sums(width):
    counts = np.random.default_rng(width).integers(0, 4, (7, width)) * 10 ** np.arange(7)[:, None]
    counts[3] = counts[2]
    totals, v = counts.sum(axis=1), width + 3
    trees = Trees(counts)
    assert trees.roots[3] == trees.roots[2]
    left, right = np.triu_indices(7, 1)
    ahead, back = priced(trees, totals, v, left, right)
    share = lambda g: [1 + 10**9 * (int(c) + 1) // (int(totals[g]) + v) for c in counts[g]]
    for i, (g, h) in enumerate(zip(left, right)):
        assert ahead[i] == sum((p - q) ** 2 // q for p, q in zip(share(g), share(h)))
        assert back[i] == sum((p - q) ** 2 // q for p, q in zip(share(h), share(g)))


def test_equal_subtrees_are_one_node_and_are_priced_once():
    trees = Trees(np.tile([0, 1, 0, 2], (5, 256)))
    assert trees.sizes == [4, 2, *[1] * 9] and len(set(trees.roots)) == 1
    which, a, b, times = trees.met(np.array([0]), np.array([1]))
    assert sorted(zip(a, b, times)) == [(0, 0, 512), (1, 1, 256), (2, 2, 256)]


def test_terms_are_cut_as_the_pattern_cuts():
    text = "Don't É-x Ab9c_d `é[Z]\x7f中文　😀\u00a0A\x00b"
    assert [t.decode() for t in terms(text)] == TERM.findall(text.translate(LOWER))


def test_chunks_and_blocks_give_the_same_values(spark):
    random.seed(5)
    docs = [(random.choice(["x", "y"]), f"s{random.randrange(9)}", " ".join(random.choices([chr(97 + k % 26) * (1 + k // 26) for k in range(60)], k=20))) for _ in range(90)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    kept = kept_counts(frame)
    dealt = pair_values(kept, groups_of(frame, kept), chunk_terms=7, block_sources=4)
    expected = {(lang, s, i): n for lang, s, part, i, n, _ in by_hand(docs) if part == "pair"}
    assert {(r["lang"], r["source"], r["item"]): r["value"] for r in dealt.collect()} == expected


def test_counts_given_out_in_parts(spark, documents):
    parts = term_counts(documents.select("lang", "source", "text"), entries=50)
    whole = term_counts(documents.select("lang", "source", "text"))
    summed = lambda f: sorted(map(tuple, f.groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()))
    assert parts.count() > whole.count() and summed(parts) == summed(whole)


def test_odd_documents(spark, odd_documents):
    expected = by_hand((r["lang"], r["source"], r["text"]) for r in odd_documents.collect())
    assert expected and found(audit(odd_documents)) == expected
    assert audit(odd_documents.limit(0)).count() == 0


def test_query_equals_counting(spark, documents):
    assert found(op11_source_divergence(spark, SF)) == by_hand((r["lang"], r["source"], r["text"]) for r in documents.collect())
