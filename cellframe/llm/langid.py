"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, with the ends of words) by rank. A document's profile
is compared with each language's by the out-of-place distance: the sum of the differences in rank, where an n-gram that
the language's profile lacks counts as the whole length of the profile.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cellframe.llm.frames import annotated, table
from cellframe.llm.registry import query
from cellframe.session import durable

UNKNOWN = "und"
_LETTER_BITS = np.uint64(21)
#: A word's end in the codes; no letter has this code point.
_END = np.uint64(1)


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a whole text's n-grams, ascending, and how often each occurs; none without letters.

    Letters are lower-cased, everything else between them is one word end, which no n-gram has in its middle. A code
    holds up to three code points of 21 bits.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    points = np.where(_letters()[points.astype(np.int64)], points, _END)
    points = np.concatenate([[_END], points, [_END]])
    points = points[np.concatenate([[True], (points[1:] != _END) | (points[:-1] != _END)])]
    if len(points) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pairs = points[:-1] << _LETTER_BITS | points[1:]
    triples = pairs[:-1] << _LETTER_BITS | points[2:]
    codes = np.concatenate([points[points != _END], pairs, triples[points[1:-1] != _END]])
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


def ranked(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent codes, ties by the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:length]]


@dataclass(frozen=True)
class Profiles:
    """Languages in order of code points, and the rank of every n-gram in each (``length`` where it has none)."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    length: int

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language of least distance (the first of several), and one minus its share of the greatest distance."""
        found = ranked(*grams(text), self.length)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        place = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        known = self.codes[place] == found
        ranks = np.where(known[:, None], self.ranks[place], self.length)
        apart = np.abs(ranks - np.arange(len(found))[:, None])
        distance = np.where(ranks == self.length, self.length, apart).sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], 1.0 - float(distance[best]) / (self.length * len(found))


def fit_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", length: int = 400, docs_per_language: int = 4000
) -> Profiles:
    """Profiles from about ``docs_per_language`` documents of each language (all, where it has fewer), drawn by a hash of
    the id and the text. Rows without a language or text teach nothing, repeated rows are drawn together. Each n-gram
    counts as often as it occurs, ties go to the smaller code. An empty table teaches no language. The profiles have
    ``length`` entries for each language, whatever the number of documents.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id), F.col(text), F.lit("profiles")).alias("h")
    )
    share = durable(known.groupBy("lang").agg((docs_per_language / F.count(F.lit(1))).alias("share")), "languages")
    drawn = known.join(share, "lang").filter(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.col("share"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counter in totals.items():
                codes = np.fromiter(counter.keys(), np.uint64, len(counter)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(counter), "code": codes, "n": np.fromiter(counter.values(), np.int64, len(counter))})
            totals.clear()

        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                counter = totals.setdefault(name, Counter())
                for code, n in zip(*(x.tolist() for x in grams(words.as_py()))):
                    counter[code] += n
                if sum(map(len, totals.values())) > 200_000:
                    yield from flush()
        yield from flush()

    rows = drawn.select("lang", "text").mapInArrow(counted, "lang string, code long, n long")
    sums = rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    best = sums.withColumn("rank", rank).filter(F.col("rank") < length).select("lang", "code", "rank")
    found = best.collect()  # at most ``length`` rows for each language
    languages = tuple(sorted({r["lang"] for r in found}))
    codes = np.unique(np.array([r["code"] for r in found], np.int64)).astype(np.uint64)
    ranks = np.full((len(codes), len(languages)), length, np.int16 if length < 1 << 15 else np.int32)
    for r in found:
        ranks[np.searchsorted(codes, np.uint64(r["code"])), languages.index(r["lang"])] = r["rank"]
    return Profiles(languages, codes, ranks, length)


def with_language(
    docs: DataFrame,
    profiles: Profiles,
    text: str = "text",
    keep: Sequence[str] | None = None,
    reject_below: float | None = None,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``lang_pred`` (a language of the profiles, or ``und`` for a null text or one without letters) and
    ``score`` (0 to 1, 1 for equal profiles, 0 for ``und``).

    Only the text is looked at, so repeated rows agree. With ``reject_below``, rows of ``und`` and rows with a smaller
    score go. Columns of ``docs`` with the names of the results, before which ``prefix`` is put, are replaced, the
    others handed on (or those in ``keep``).
    """

    def describe(texts: list[str | None]) -> dict[str, Sequence]:
        found = [profiles.nearest(t) for t in texts]
        good = [name != UNKNOWN and (reject_below is None or score >= reject_below) for name, score in found]
        return {f"{prefix}lang_pred": [f[0] for f in found], f"{prefix}score": [f[1] for f in found], "known!": good}

    ddl = f"`{prefix}lang_pred` string, `{prefix}score` double, `known!` boolean"
    return annotated(docs, text, ddl, describe, keep, only=None if reject_below is None else "known!").drop("known!")


def held_out(id: Column, folds: int = 5) -> Column:
    """Whether a document is kept for tests: crc32 of its id as text leaves no remainder. False for a null id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(False))


@query("op3_rank_profiles")
def op3_rank_profiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = fit_profiles(docs.filter(~held_out(F.col("doc_id"))))
    found = with_language(docs.select("doc_id", "text"), profiles, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
