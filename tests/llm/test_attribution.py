from collections import Counter

import numpy as np
import pytest

from cellframe.llm.attribution import RULES, allocate, attributed, line_sections, op4_section_tokens, token_spans, totals
from cellframe.llm.encode import Encoder, default_tokenizer
from conftest_llm import SF, rows


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_tokenizer())


def test_spans_agree_with_the_library(coder, documents):
    texts = [r["text"] for r in documents.limit(60).collect()] + ["é ñ", "中文😀!", " lead", "a  b\n\n c"]
    for text in texts:
        for (a, b), (c, d) in zip(token_spans(coder, text).tolist(), coder.library_spans(text)[1].tolist()):
            # The library leaves white space at a token's ends out of its span.
            assert (a <= c or b == c) and b >= d and text[a:c].isspace() | (a == c) or text[a:b].isspace()


def test_spans_cover_every_character(coder):
    for text in ("plain words here", "é中\n\n x"):
        spans = token_spans(coder, text)
        assert set().union(*(range(a, b) for a, b in spans)) == set(range(len(text)))
    assert token_spans(coder, "").shape == (0, 2)


def by_hand(spans, sections, rule):
    counts = [0.0] * (len(sections) + 1)
    for a, b in spans:
        inside = [next((k for k, (s, e) in enumerate(sections) if s <= c < e), len(sections)) for c in range(a, b)]
        if rule == "start":
            counts[inside[0]] += 1
        elif rule == "end":
            counts[inside[-1]] += 1
        elif rule == "majority":
            counts[max(sorted(set(inside)), key=inside.count)] += 1
        else:
            for k in inside:
                counts[k] += 1 / len(inside)
    return counts


@pytest.mark.parametrize("rule", RULES)
def test_rules_equal_counting_characters(rule):
    random = np.random.default_rng(3)
    for _ in range(50):
        edges = np.unique(random.integers(0, 60, 20))
        spans = np.stack([edges[:-1], edges[1:]], axis=1)
        cuts = np.unique(random.integers(0, 60, 9))
        sections = [(int(s), int(e)) for s, e in zip(cuts[::2], cuts[1::2])]
        counts, _ = allocate(spans, np.array([s for s, _ in sections]), np.array([e for _, e in sections]), rule)
        assert counts.tolist() == pytest.approx(by_hand(spans.tolist(), sections, rule))


def test_sections_of_a_column(spark):
    frame = spark.createDataFrame([(1, "one two", [("a", 0, 5), ("b", 5, 7)]), (2, None, None), (3, "", [])], "doc_id long, text string, s array<struct<name:string,start:int,end:int>>")
    found = {(r["doc_id"], r["section"]): (r["name"], r["n_tokens"], r["n_shared"]) for r in attributed(frame, default_tokenizer(), "split", "s").collect()}
    assert found == {(1, 0): ("a", 1.5, 1), (1, 1): ("b", 0.5, 1), (2, -1): (None, 0.0, 0), (3, -1): (None, 0.0, 0)}
    with pytest.raises(ValueError):
        attributed(frame, default_tokenizer(), "most")


def test_odd_documents(spark, odd_documents, coder):
    found = rows(attributed(odd_documents, default_tokenizer()))
    expected = sum(len(coder.ids(r["text"])) // 4 for r in odd_documents.collect())
    assert sum(r["n_tokens"] for r in found) == expected
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in odd_documents.collect()}
    assert attributed(odd_documents.limit(0), default_tokenizer()).count() == 0


def test_query_equals_the_library_line_by_line(spark, documents):
    """Every token of every document goes to the line with most of its characters, the earlier one of several."""
    tokenizer = Encoder(default_tokenizer())._tokenizer
    found = {(r["doc_id"], r["section"]): r for r in op4_section_tokens(spark, SF).collect()}
    listed = 0
    for r in documents.collect():
        text = r["text"] or ""
        lines = line_sections(text)
        of_char = [k for k, (_, start, end) in enumerate(lines) for _ in range(end - start)]
        counts, shared = Counter(), Counter()
        for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
            parts = Counter(of_char[a : max(b, a + 1)])
            counts[min(parts, key=lambda k: (-parts[k], k))] += 1
            if len(parts) > 1:
                shared.update(parts.keys())
        for k, (name, start, end) in enumerate(lines):
            row = found[r["doc_id"], k]
            assert (row["name"], row["char_start"], row["char_end"], row["n_tokens"], row["n_shared"]) == (name, start, end, counts[k], shared[k])
        listed += max(1, len(lines))
    assert len(found) == listed
    assert totals(attributed(documents, default_tokenizer())).filter("name = 'title'").count() == documents.filter("text <> ''").count()
