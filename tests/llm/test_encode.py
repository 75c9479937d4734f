import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cellframe.llm.encode import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_tokenizer(), memo_entries=50)


PARTS = st.sampled_from(["word", "Über", "ñ", " ", "  ", "\n", "\t", "\x1c", "　", "don't", "...", "12", "中文", "😀", "<|endoftext|>", "!?", "a-b"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=12).map("".join), st.lists(PARTS, max_size=12).map(" ".join), st.text(max_size=20)))
def test_ids_are_those_of_the_library(coder, text):
    expected = coder._tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.ids(text), "<u4").tolist() == expected


def test_null_and_empty(coder):
    assert coder.ids(None) == coder.ids("") == b""
