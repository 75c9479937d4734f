"""Runs: stretches of a text whose words repeat with a period, found through Lyndon roots.

Every run of period q holds a Lyndon word of length q under one of two opposite orders of the words. Baier's grouping,
the first phase of his suffix sorter, ends with each suffix in the group of its longest Lyndon prefix, so it gives the
length of the longest Lyndon word at every place (the Lyndon array) directly; it is run under both orders. Each such
word is a root that the longest common extensions to both sides either carry to a run of at least two periods or not.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellframe.llm.frames import WORD, annotated, table
from cellframe.llm.registry import query

#: Words that are worked on together; a longer stretch is worked on alone.
_AT_ONCE = 1 << 16


def lyndon_lengths(letters: list[int], kinds: int) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by Baier's grouping.

    ``letters`` are numbers below ``kinds``, the greater the later in order; a negative one is a barrier, which no word
    crosses and of which the length is 0. The first letter is a barrier.

    A group holds the places with one known prefix, groups are in the order of their prefixes, and the highest one is
    taken first. A taken place goes out of the row of places, and the place now left of it takes the group's prefix as
    often behind its own as it is met: it moves to a group right above its own.
    """
    n = len(letters)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, c in enumerate(letters):
        if c >= 0:
            members[c].append(i)
    group = list(letters)
    size, below, above = [1] * kinds, list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    left, right = list(range(-1, n)), list(range(1, n + 1))
    lengths = [0] * n
    current = kinds - 1
    while current >= 0:
        prefix, moved = size[current], {}
        last, times = 0, 0
        for s in members[current]:
            if group[s] != current:
                continue
            lengths[s] = prefix
            before, after = left[s], right[s]
            right[before] = after
            left[after] = before
            if before == last:
                times += 1
                continue
            if letters[last] >= 0:
                moved.setdefault((times, group[last]), []).append(last)
            last, times = before, 1
        if letters[last] >= 0:
            moved.setdefault((times, group[last]), []).append(last)
        for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            places, new = moved[times, old], len(size)
            for p in places:
                group[p] = new
            members.append(places)
            size.append(size[old] + times * prefix)
            up = above[old]
            above[old] = new
            below.append(old)
            above.append(up)
            if up < new:
                below[up] = new
        current = below[current]
    return lengths


class Extensions:
    """Longest common extensions of pairs of places, by numbers for all substrings of 1, 2, 4, ... letters."""

    def __init__(self, letters: np.ndarray) -> None:
        self.n = len(letters)
        self.numbers = [np.unique(letters, return_inverse=True)[1].astype(np.int64)]
        width = 1
        while 2 * width <= self.n and self.numbers[-1].max() + 1 < len(self.numbers[-1]):
            last = self.numbers[-1]
            self.numbers.append(np.unique(last[:-width] * (last.max() + 1) + last[width:], return_inverse=True)[1])
            width *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that agree from i and from j > i on."""
        length = np.zeros_like(i)
        for k in range(len(self.numbers) - 1, -1, -1):
            numbers, j_at = self.numbers[k], j + length
            fits = j_at < len(numbers)
            length += (fits & (numbers[np.where(fits, i + length, 0)] == numbers[np.where(fits, j_at, 0)])).astype(np.int64) << k
        return length

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that agree before i and before j > i."""
        length = np.zeros_like(i)
        for k in range(len(self.numbers) - 1, -1, -1):
            numbers, i_at = self.numbers[k], i - length - (1 << k)
            fits = i_at >= 0
            length += (fits & (numbers[np.where(fits, i_at, 0)] == numbers[np.where(fits, j - length - (1 << k), 0)])).astype(np.int64) << k
        return length


def runs_of(letters: np.ndarray, kinds: int, least: int = 2) -> np.ndarray:
    """Rows ``(start, length, period)``, by start and then period, of all runs of ``least`` letters and two periods.

    Negative letters are barriers, each a number of its own, and the first letter is one.
    """
    at = np.flatnonzero(letters >= 0)
    found = []
    extensions = Extensions(letters)
    for order in (letters, np.where(letters >= 0, kinds - 1 - letters, -1)):
        period = np.array(lyndon_lengths(order.tolist(), kinds), np.int64)[at]
        inside = at + period < len(letters)
        i, p = at[inside], period[inside]
        ahead, back = extensions.right(i, i + p), extensions.left(i, i + p)
        run = (ahead + back >= p) & (ahead + back + p >= least)
        found.append(np.stack([i - back, ahead + back + p, p], axis=1)[run])
    both = np.concatenate(found)
    return np.unique(both, axis=0)[:, [0, 1, 2]] if len(both) else both


def _stretches(words: list[bytes], least: int) -> list[tuple[int, int]]:
    """Stretches outside of which no run lies: those covered by sequences of least / 2 words that come twice.

    A run's sequence of that length comes again one period later, and such sequences cover the whole run.
    """
    gram, n = least // 2, len(words)
    if n < least:
        return []
    if gram < 1:
        return [(0, n)]
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    keys = hashes[: n - gram + 1].copy()
    for k in range(1, gram):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - gram + 1 + k]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return []
    steps = np.zeros(n + 1, np.int64)
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    steps[: len(keys)] += again
    steps[gram : gram + len(keys)] -= again
    edges = np.diff(np.concatenate([[0], (np.cumsum(steps[:n]) > 0).astype(np.int8), [0]]))
    return [(a, b) for a, b in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist()) if b - a >= least]


def runs_in_texts(texts: Iterable[str | None], least: int) -> tuple[list[np.ndarray], list[str]]:
    """For each text its runs (start, length, period) in words, and the text without what runs repeat."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    found: list[list[np.ndarray]] = [[] for _ in words]
    letters: list[int] = []
    begun: list[tuple[int, int, int]] = []  # place in the letters, text, word
    numbers: dict[bytes, int] = {}

    def work() -> None:
        if not begun:
            return
        runs = runs_of(np.array(letters, np.int64), len(numbers), least)
        which = np.searchsorted([b[0] for b in begun], runs[:, 0], side="right") - 1
        for k in np.unique(which).tolist():
            place, text, word = begun[k]
            found[text].append(runs[which == k] + [word - place, 0, 0])
        letters.clear()
        begun.clear()
        numbers.clear()

    for text, its in enumerate(words):
        for a, b in _stretches(its, least):
            letters.append(-1 - len(begun))
            begun.append((len(letters), text, a))
            letters.extend(numbers.setdefault(w, len(numbers)) for w in its[a:b])
            if len(letters) >= _AT_ONCE:
                work()
    work()
    none = np.zeros((0, 3), np.int64)
    runs = [np.concatenate(f) if f else none for f in found]
    return runs, [_collapsed(w, r) for w, r in zip(words, runs)]


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def with_runs(docs: DataFrame, text: str = "text", least: int = 12, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start and period, and ``collapsed``, the words that
    no run repeats, joined by one space.

    Words are runs of anything but ASCII white space, numbered from 0. A run is as long as its period lasts, at least
    ``least`` words and two periods. Null texts and those without words have no runs and an empty ``collapsed``.
    Texts are read whole, and memory grows with the longest one. Repeated rows stay, an empty table stays empty, and
    columns of ``docs`` that have the names of the results, before which ``prefix`` is put, are replaced.
    """
    columns = f"`{prefix}runs` array<struct<start:long,length:long,period:long>>, `{prefix}collapsed` string"

    def describe(texts: list[str | None]) -> dict[str, list]:
        runs, collapsed = runs_in_texts(texts, least)
        listed = [[dict(zip(("start", "length", "period"), r)) for r in found.tolist()] for found in runs]
        return {f"{prefix}runs": listed, f"{prefix}collapsed": collapsed}

    return annotated(docs, text, columns, describe, keep)


def _planted(id: Column, text: Column) -> Column:
    """The text, and for one id in ten its words with a tail that repeats; a null id has the hash 0."""
    h = F.coalesce(F.crc32(id.cast("string")), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    g, n = F.call_function("div", h, F.lit(10)), F.size(words).cast("long")
    # an array that is made once for each row, and from it the tail's first word and its period
    given = F.array(F.struct(words.alias("words"), F.pmod(g, n).alias("a"), n.alias("n")))

    def repeated(r: Column) -> Column:
        p = 1 + F.call_function("div", r["n"] - r["a"], 3 + F.pmod(g, F.lit(8)))
        place = lambda w, i: F.when(i < r["a"], w).otherwise(F.get(r["words"], (r["a"] + F.pmod(i - r["a"], p)).cast("int")))
        return F.array_join(F.transform(r["words"], place), " ")

    return F.when((h % 10 == 0) & text.rlike(WORD), F.get(F.transform(given, repeated), 0)).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = with_runs(docs, keep=["doc_id"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("longest.shorter")
    exponent = F.call_function("div", 1000 * length, F.col("longest.period"))
    return named.select("doc_id", "n_runs", F.col("longest.start").alias("start"), length.alias("length"), F.col("longest.period").alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
