import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cellframe.llm.repeats import Extensions, lyndon_lengths, op12_periodic_runs, runs_in_texts, runs_of, with_runs
from conftest_llm import SF, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, least=12):
    """Every stretch with its smallest period that no neighbour extends, by trying all periods."""
    n, found, seen = len(words), [], set()
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= 2 * q and (start, end) not in seen:
                seen.add((start, end))
                if end - start >= least:
                    found.append((start, end - start, q))
            start = end - q + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def by_hand(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": longest and longest[0],
        "length": longest and longest[1],
        "period": longest and longest[2],
        "exponent_milli": longest and 1000 * longest[1] // longest[2],
        "runs_sha256": sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    }


def longest_lyndon(letters, i):
    best = 0
    for end in range(i + 1, len(letters) + 1):
        word = letters[i:end]
        if -1 in word:
            break
        if all(word < word[k:] for k in range(1, len(word))):
            best = len(word)
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1, 2), max_size=18))
def test_grouping_gives_the_lyndon_array(letters):
    letters = [-1, *letters]
    assert lyndon_lengths(letters, 3) == [longest_lyndon(letters, i) for i in range(len(letters))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=40))
def test_extensions(letters):
    pairs = [(i, j) for i in range(len(letters)) for j in range(i + 1, len(letters))]
    i, j = (np.array(x, np.int64) for x in zip(*pairs))
    made = Extensions(np.array(letters))
    right = [next((k for k in itertools.count() if b + k >= len(letters) or letters[a + k] != letters[b + k])) for a, b in pairs]
    left = [next((k for k in itertools.count() if a - k - 1 < 0 or letters[a - k - 1] != letters[b - k - 1])) for a, b in pairs]
    assert made.right(i, j).tolist() == right and made.left(i, j).tolist() == left


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30))
def test_runs_equal_trying_all_periods(letters):
    found = runs_of(np.array([-1, *letters], np.int64), 3)
    assert [(s - 1, n, q) for s, n, q in found.tolist()] == all_runs(letters, 2)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_texts_equal_trying_all_periods(least):
    random.seed(least)
    texts = [None, "", " \t "]
    for _ in range(150):
        words = [random.choice("abcdefgh") for _ in range(random.randrange(30))]
        for _ in range(random.randrange(4)):
            again = [random.choice("abXY") for _ in range(random.randrange(1, 9))]
            words[random.randrange(len(words) + 1) : 0] = (again * 9)[: random.randrange(40)]
        texts.append(" ".join(words))
    found, collapsed = runs_in_texts(texts, least)
    for text, runs, rest in zip(texts, found, collapsed):
        words = WORD.findall(text or "")
        expected = all_runs(words, least)
        assert list(map(tuple, runs.tolist())) == expected
        dropped = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert rest == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_a_long_text_of_one_word_and_one_of_a_long_period():
    words = [str(k) for k in range(30_000)]
    found, collapsed = runs_in_texts(["x " * 200_000, " ".join(words * 3)], 12)
    assert found[0].tolist() == [[0, 200_000, 1]] and collapsed[0] == "x"
    assert found[1].tolist() == [[0, 90_000, 30_000]] and collapsed[1] == " ".join(words)


def test_odd_documents(spark, odd_documents):
    frame = odd_documents.selectExpr("*", "'x' as runs", "'y' as collapsed", "'z' as `a.runs`")
    found = rows(with_runs(frame))
    assert len(found) == odd_documents.count() and set(found[0]) == set(frame.columns)
    for r in found:
        words = WORD.findall(r["text"] or "")
        assert [tuple(x) for x in r["runs"]] == (all_runs(words) if len(words) < 1000 else [(0, 40_000, 10)])
    assert rows(with_runs(frame, prefix="a."))[0]["runs"] == "x"
    assert with_runs(frame.limit(0)).count() == 0


def test_query_equals_trying_all_periods(spark, documents):
    expected = [by_hand(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sum(e["n_runs"] > 0 for e in expected) > 10
    assert sorted(rows(op12_periodic_runs(spark, SF)), key=lambda r: r["doc_id"]) == sorted(expected, key=lambda r: r["doc_id"])


def test_query_on_odd_rows(spark, odd_documents, tmp_path):
    hits = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    more = [(hits[0], "one"), (hits[1], "a b c d e f g h i j k l m n " * 9), (hits[2], ""), (hits[3], None), (hits[4], " \n"), (hits[5], "é 中 " * 30)]
    docs = odd_documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["collapsed_sha256"])
    found = sorted(rows(op12_periodic_runs(spark, str(tmp_path))), key=key)
    long = [r for r in found if r["doc_id"] == 7]
    expected = sorted((by_hand(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 7), key=key)
    assert [r for r in found if r["doc_id"] != 7] == expected
    assert (long[0]["n_runs"], long[0]["length"], long[0]["period"]) == (1, 40_000, 10)
