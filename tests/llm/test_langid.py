import zlib
from collections import Counter

import numpy as np
import pytest

from cellframe.llm.langid import UNKNOWN, Profiles, fit_profiles, grams, held_out, op3_rank_profiles, with_language
from conftest_llm import SF, rows


def plain_grams(text):
    word = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = "_" + "_".join(word) + "_" if word else ""
    found = Counter(c for c in padded if c != "_")
    found.update(padded[i : i + 2] for i in range(len(padded) - 1))
    found.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != "_")
    return found


def spelled(code):
    """A code's characters; a word end is code point 1."""
    points, code = [], int(code)
    while code:
        points.append(code & 0x1FFFFF)
        code >>= 21
    return "".join("_" if p == 1 else chr(p) for p in reversed(points))


@pytest.mark.parametrize("text", ["a", "Hello, world! hello", "ß Äa 中文😀 x1y", "ab\n\nab"])
def test_grams_equal_plain_counting(text):
    codes, counts = grams(text)
    assert {spelled(c): n for c, n in zip(codes.tolist(), counts.tolist())} == plain_grams(text)


def test_no_letters():
    assert all(len(grams(t)[0]) == 0 for t in (None, "", "12 .. \n"))


def test_distance_by_hand():
    codes = np.array([1, 2, 3], np.uint64) + np.uint64(ord("a") - 1)
    profiles = Profiles(("x", "y"), codes, np.array([[0, 3], [1, 0], [3, 1]]), 3)
    # "a" alone ranks as: a, then the pairs and the triple with word ends, of which no profile knows any.
    assert profiles.nearest("a")[0] == "x"
    assert Profiles((), codes, np.zeros((3, 0), int), 3).nearest("a") == (UNKNOWN, 0.0)


def test_odd_documents(spark, odd_documents):
    profiles = fit_profiles(odd_documents)
    assert profiles.languages == ("de", "en", "fr")
    found = rows(with_language(odd_documents, profiles))
    assert len(found) == odd_documents.count() and {"taken", "kept"} <= set(found[0])
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == UNKNOWN) == (not letters) and 0 <= r["score"] <= 1
    assert with_language(odd_documents, profiles, reject_below=0.0).count() == sum(r["lang_pred"] != UNKNOWN for r in found)
    kept = with_language(odd_documents, profiles, prefix="p!").first()
    assert kept["score"] == "x" and 0 <= kept["p!score"] <= 1
    assert fit_profiles(odd_documents.limit(0)).languages == ()
    assert with_language(odd_documents.limit(0), profiles).count() == 0


def test_held_out_folds(spark):
    found = spark.createDataFrame([(i,) for i in [None, *range(50)]], "i long")
    for r in found.select("i", held_out(found["i"]).alias("h")).collect():
        assert r["h"] == (r["i"] is not None and zlib.crc32(str(r["i"]).encode()) % 5 == 0)


def test_held_out_accuracy(spark, documents):
    langs = {r["doc_id"]: (r["lang"], r["text"]) for r in documents.collect()}
    found = [r for r in op3_rank_profiles(spark, SF).collect()]
    assert len(found) == len(langs)
    out = [langs[r["doc_id"]][0] == r["lang_pred"] for r in found if r["held_out"]]
    assert len(out) > 20 and sum(out) / len(out) > 0.95


def code_of(gram):
    code = 0
    for c in gram:
        code = code << 21 | (1 if c == "_" else ord(c))
    return code


def top(counts, length=400):
    return sorted(counts, key=lambda g: (-counts[g], code_of(g)))[:length]


def test_query_equals_profiles_by_hand(spark, documents):
    """Profiles counted over all documents that are not held out, and every document's distance to each of them."""
    docs = documents.collect()
    learned = {}
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            learned.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    ranks = {lang: {g: k for k, g in enumerate(top(counts))} for lang, counts in learned.items()}
    found = {r["doc_id"]: r for r in op3_rank_profiles(spark, SF).collect()}
    for r in docs:
        own = top(plain_grams(r["text"] or ""))
        distances = {lang: sum(abs(known[g] - k) if g in known else 400 for k, g in enumerate(own)) for lang, known in sorted(ranks.items())}
        best = min(distances, key=distances.get) if own else UNKNOWN
        assert found[r["doc_id"]]["lang_pred"] == best
        assert found[r["doc_id"]]["score"] == pytest.approx(1 - distances[best] / (400 * len(own)) if own else 0.0)


def test_more_than_a_thousand_languages(spark):
    frame = spark.range(1300).selectExpr("id as doc_id", "concat('l', id) as lang", "concat(hex(id + 100000), ' ', translate(cast(id as string), '0123456789', 'qwertyuiop')) as text")
    profiles = fit_profiles(frame, length=20)
    assert len(profiles.languages) == 1300
    found = with_language(frame.filter("doc_id % 50 = 0"), profiles).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.8 * len(found)
