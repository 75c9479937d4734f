import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellframe.llm.encode import Encoder, default_tokenizer
from cellframe.llm.packing import op5_deficit_packing, pack, sequences
from conftest_llm import SF, rows


def assert_whole(found, expected):
    """Every document's ids lie in exactly one piece each, and sequences are gapless."""
    coder, got = Encoder(default_tokenizer()), defaultdict(list)
    for r in found:
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], f"<u{r['id_bytes']}").tolist()))
    for key, ids in expected.items():
        pieces = sorted(got[key])
        copies = Counter()
        for start, part in pieces:
            assert ids[start : start + len(part)] == part
            copies.update(range(start, start + len(part)))
        assert set(copies.values()) <= {copies[0]} and len(copies) == len(ids)
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for number, own in places.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == WINDOW or number == max(places)
    assert sorted(places) == list(range(len(places)))


WINDOW = 64


def ids_of(documents, end):
    coder = Encoder(default_tokenizer())
    out = {}
    for r in documents:
        ids = [*np.frombuffer(coder.ids(r["text"]), "<u4").tolist(), end]
        out[r["doc_id"], len(ids)] = ids
    return out


def test_odd_documents(spark, odd_documents):
    found = rows(pack(odd_documents.repartition(3, "doc_id"), default_tokenizer(), 1, window=WINDOW, longest_piece=10, rounds_per_block=2))
    assert_whole(found, ids_of([r for r in odd_documents.collect() if r["doc_id"] is not None], 1))
    assert pack(odd_documents.limit(0), default_tokenizer(), 1).count() == 0


def test_windows_follow_their_targets(spark, documents):
    targets = {"src0": 0.5, "src1": 0.3, "src2": 0.2}
    some = documents.filter(documents.source.isin(*targets))
    found = rows(pack(some, default_tokenizer(), 1, window=WINDOW, targets=targets, longest_piece=8, rounds_per_block=4))
    assert_whole(found, ids_of(some.collect(), 1))
    left = Counter()
    for r in found:
        left[r["source"]] += r["length"]
    total = Counter()
    by_sequence = defaultdict(Counter)
    for r in found:
        by_sequence[r["sequence_id"]][r["source"]] += r["length"]
    for number in sorted(by_sequence):
        total.update(by_sequence[number])
        if any(total[s] == left[s] for s in targets):
            break
        for s, share in targets.items():
            assert abs(total[s] - share * WINDOW * (number + 1)) <= 2 * 8
    assert number > 10


@pytest.mark.parametrize("targets", [{"src0": 1.0, "src1": 0.0}, {"src0": 0.0}, {"src0": 0.0, "src1": 0.7, "src2": 0.3}, {}])
def test_sources_without_a_share_come_last_and_whole(spark, documents, targets):
    some = documents.filter(documents.source.isin("src0", "src1", "src2", "src3"))
    found = rows(pack(some, default_tokenizer(), 1, window=WINDOW, targets=targets, longest_piece=8, rounds_per_block=4))
    assert_whole(found, ids_of(some.collect(), 1))
    first = {s: min((r["sequence_id"], r["offset"]) for r in found if r["source"] == s) for s in ("src0", "src1", "src2", "src3")}
    last = {s: max((r["sequence_id"], r["offset"]) for r in found if r["source"] == s) for s in first}
    served = [s for s in first if targets.get(s, 0) > 0]
    assert all(first[late] > last[s] for s in served for late in first if late not in served)


def test_negative_targets_are_refused(spark, documents):
    with pytest.raises(ValueError):
        pack(documents.limit(3), default_tokenizer(), 1, targets={"a": -1.0})


def test_sequences_put_pieces_together(spark, documents):
    packed = pack(documents.limit(20), default_tokenizer(), 1, window=WINDOW, longest_piece=8)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in sequences(packed).collect()}
    for r in packed.collect():
        at = r["offset"] * r["id_bytes"]
        assert whole[r["sequence_id"]][at : at + len(r["ids"])] == bytes(r["ids"])


def test_query_equals_brute_force(spark, documents):
    tokenizer = Encoder(default_tokenizer())._tokenizer
    found = defaultdict(list)
    for r in op5_deficit_packing(spark, SF).collect():
        found[r["doc_id"]].append(r)
    filled = Counter()
    for r in documents.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(found[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
            filled[p["sequence_id"]] += p["length"]
        assert at == len(ids)
    assert all(n == 2048 for s, n in filled.items() if s < max(filled))
