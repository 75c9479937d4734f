import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from cellframe.llm.encode import Encoder, default_tokenizer
from cellframe.llm.frames import read_blobs, scratch
from cellframe.llm.token_files import EliasFano, Segment, op1_token_files, read_token_files, segment_bytes, write_token_files
from conftest_llm import SF


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 600), max_size=700).map(sorted))
def test_elias_fano_gives_back_every_number(values):
    code = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert code.all().tolist() == values
    assert [code.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_near_its_bound():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(EliasFano.encode(ends).to_bytes()) * 8 / len(ends) < 2.5 + np.log2(ends[-1] / len(ends))


def test_segment_selects_documents():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 5)]
    segment = Segment(segment_bytes(4, 2, [None, -7, 9], ids, 2) + b"\n")
    assert (segment.part, segment.number, segment.doc_ids()) == (4, 2, [None, -7, 9])
    assert [segment.ids(i).tolist() for i in range(3)] == [[0, 1, 2], [], [0, 1, 2, 3, 4]]


def test_round_trip_of_odd_documents(spark, odd_documents):
    path = scratch(spark, "tokens")
    write_token_files(odd_documents.repartition(3), path, default_tokenizer(), end_id=2, segment_ids=5000, segment_docs=3)
    assert read_blobs(spark, f"{path}/segments").count() > 3
    found = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in read_token_files(spark, path, "ids").collect())
    coder = Encoder(default_tokenizer())
    expected = [(r["doc_id"], coder.ids(r["text"]) + b"\2\0\0\0") for r in odd_documents.collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(d, i) for _, d, i in found], key=key) == sorted(expected, key=key)
    assert [d for _, d, _ in found] == sorted((d for _, d, _ in found), key=lambda d: (d is not None, d or 0))
    starts = np.cumsum([0] + [len(i) // 4 for _, _, i in found])[:-1]
    assert [s for s, _, _ in found] == starts.tolist()


def test_empty_table(spark, odd_documents):
    path = scratch(spark, "tokens")
    write_token_files(odd_documents.limit(0), path, default_tokenizer(), end_id=2)
    assert read_token_files(spark, path).count() == 0


def test_query_equals_brute_force(spark, documents):
    tokenizer = Encoder(default_tokenizer())._tokenizer
    start, expected = 0, []
    for r in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = op1_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == expected
