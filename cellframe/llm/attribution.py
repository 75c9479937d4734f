"""Token counts of sections: a document is encoded once, whole, and its tokens' character spans are joined with the
spans of its sections. A token that lies in several sections is allocated by an explicit rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellframe.llm.encode import Encoder, default_tokenizer, encoder
from cellframe.llm.frames import table
from cellframe.llm.registry import query

RULES = ("start", "end", "majority", "split")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def token_spans(coder: Encoder, text: str) -> np.ndarray:
    """Character spans ``[start, end)`` of a whole text's tokens, one row each, in order.

    A byte-level vocabulary tells how many bytes of text are behind each id, so the spans follow from a running total
    and cover the text without gaps, leading spaces included; a token with part of a character's bytes covers that
    character. Other vocabularies give their own offsets.
    """
    ids = np.frombuffer(coder.ids(text), "<u4")
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if coder.byte_level and int(coder.byte_lengths[ids].sum()) == len(data):
        ends = np.cumsum(coder.byte_lengths[ids])
        first = ((data & 0xC0) != 0x80).astype(np.int64)
        chars = np.concatenate([[0], np.cumsum(first)])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        inner = np.zeros(0, np.int64) if not len(ids) else 1 - first[np.minimum(starts, len(data) - 1)]
        return np.stack([chars[starts] - inner, chars[ends]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)
    return coder.library_spans(text)[1]


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """``(name, start, end)``: the first line is the title, the others are body; a line holds its line feed."""
    return [("body" if k else "title", m.start(), m.end()) for k, m in enumerate(_LINE.finditer(text))]


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by ``rule``, and how many tokens it shares; one place more for what lies in no section.

    Sections are in order and don't overlap. ``start`` and ``end`` look at a token's first and last character,
    ``majority`` at most of its characters (the earlier section of several), ``split`` gives each section its share of
    the characters.
    """
    n = len(starts)
    counts, shared = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    if not n:
        counts[n] = len(spans)
        return counts, shared
    lasts = np.maximum(spans[:, 1] - 1, spans[:, 0])

    def section(place: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, place, "right") - 1
        return np.where((k >= 0) & (place < ends[np.maximum(k, 0)]), k, n)

    a, b = section(spans[:, 0]), section(lasts)
    gaps = np.searchsorted(starts, spans[:, 0], "right") != np.searchsorted(starts, lasts, "right")
    crossing = (a != b) | gaps
    given = b if rule == "end" else a
    whole = ~crossing if rule in ("majority", "split") else np.ones(len(spans), bool)
    counts += np.bincount(given[whole], minlength=n + 1)
    for s, e in spans[crossing]:
        places, chars = np.unique(section(np.arange(s, e)), return_counts=True)
        shared[places] += 1
        if rule == "split":
            counts[places] += chars / chars.sum()
        elif rule == "majority":
            counts[places[np.argmax(chars)]] += 1
    return counts, shared


def attributed(
    docs: DataFrame, tokenizer: str, rule: str = "majority", sections: str | None = None, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row for each section: ``doc_id``, ``section`` (from 0), ``name``, ``char_start``, ``char_end``, ``n_tokens``
    (by ``rule``, fractions only for ``split``) and ``n_shared`` (its tokens that also lie elsewhere).

    ``sections`` is a column of ``array<struct<name:string,start:int,end:int>>``, in order and without overlap; by
    default sections are lines. Tokens in no section come as section -1, where there are any. A null or empty text, or
    null sections, give one row of section -1, so each document has a row and its tokens add up. Repeated rows give
    repeated results; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), *([] if sections is None else [F.col(sections).alias("s")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for k in range(batch.num_rows):
                words = batch.column(1)[k].as_py() or ""
                if sections is None:
                    parts = line_sections(words)
                else:
                    parts = [(s["name"], s["start"], s["end"]) for s in batch.column(2)[k].as_py() or []]
                starts, ends = np.array([p[1] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64)
                counts, shared = allocate(token_spans(coder, words), starts, ends, rule)
                outside = bool(counts[-1]) or bool(shared[-1]) or not parts
                n = len(parts) + outside
                out[0] += [batch.column(0)[k].as_py()] * n
                out[1] += [*range(len(parts)), -1][:n] if outside else range(len(parts))
                out[2] += [p[0] for p in parts] + [None] * outside
                out[3] += [p[1] for p in parts] + [None] * outside
                out[4] += [p[2] for p in parts] + [None] * outside
                out[5] += counts[:n].tolist()
                out[6] += shared[:n].tolist()
                if len(out[0]) >= 20_000 or k == batch.num_rows - 1:
                    arrays = [pa.array(x, t) for x, t in zip(out, kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    out = [[] for _ in range(7)]
        coder.forget()

    names = ["doc_id", "section", "name", "char_start", "char_end", "n_tokens", "n_shared"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return rows.mapInArrow(count, "doc_id long, section long, name string, char_start long, char_end long, n_tokens double, n_shared long")


def totals(counts: DataFrame) -> DataFrame:
    """Tokens of each document by section name."""
    return counts.groupBy("doc_id", "name").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_shared").alias("n_shared"))


@query("op4_section_tokens")
def op4_section_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counts = attributed(table(spark, folder, "documents"), default_tokenizer(), rule="majority")
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))
