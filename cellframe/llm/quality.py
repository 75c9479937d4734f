"""Quality rules: boosted trees over statistics of a document, kept as flat numpy arrays of nodes.

The trees are fitted to labelled documents with the logistic loss over quantile bins. A feature with a constraint of -1
(1) can only lower (raise) the score as it grows: a split that breaks the order of its two sides is not taken, and the
value between them bounds everything below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellframe.llm.frames import annotated, table
from cellframe.llm.registry import query

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features of the trees, and the direction in which the score may go as each grows.
FEATURES: Mapping[str, int] = {
    "log_words": 0,
    "word_length": 0,
    "symbol_ratio": -1,
    "dup_line_ratio": -1,
    "repeat_ratio": -1,
    "distinct_ratio": 0,
    "top_word_ratio": -1,
    "upper_ratio": -1,
    "digit_ratio": -1,
    "mark_ratio": 0,
    "adjacent_ratio": -1,
    "words_per_line": 0,
    "ended_lines": 0,
}

_KINDS = np.zeros(256, np.uint8)
_SPACE, _SYMBOL, _UPPER, _DIGIT, _MARK, _INNER = 1, 2, 3, 4, 5, 6
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[list(b"\"'(),-./:;?@[\\]^_`{}~+=!")] = _MARK
_KINDS[list(b"#*$%&|<>")] = _SYMBOL
_KINDS[ord("A") : ord("Z") + 1] = _UPPER
_KINDS[ord("0") : ord("9") + 1] = _DIGIT
_KINDS[0x80:0xC0] = _INNER


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """``STATISTICS`` and ``FEATURES`` of a whole text; null counts as empty, and empty gives zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=7)
    words = data.split()
    n = len(words)
    if not n:
        return [0] * len(STATISTICS), [0.0] * len(FEATURES)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = _repeated(ids, len(number))
    chars = len(data) - int(kinds[_INNER]) - int(kinds[_SPACE])
    counted = [n, chars, int(kinds[_SYMBOL]), len(lines) - len(set(lines)), repeated]
    ended = sum(line.rstrip()[-1] in b".!?" for line in lines)
    features = [
        float(np.log1p(n)),
        chars / n,
        kinds[_SYMBOL] / chars,
        (len(lines) - len(set(lines))) / len(lines),
        repeated / n,
        len(number) / n,
        int(np.bincount(ids).max()) / n,
        kinds[_UPPER] / chars,
        kinds[_DIGIT] / chars,
        kinds[_MARK] / chars,
        int(np.count_nonzero(ids[1:] == ids[:-1])) / n,
        n / len(lines),
        ended / len(lines),
    ]
    return counted, features


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[place] > 1
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[k : k + len(again)] |= again
    return int(np.count_nonzero(marked))


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees side by side: rows go left while ``feature`` <= ``cut``; a leaf points at itself.

    ``taught`` is false where there was no row to learn from.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    taught: bool = True

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Chance of good quality, one for each row of ``features``."""
        at = np.tile(self.roots, (len(features), 1))
        rows = np.arange(len(features))[:, None]
        for _ in range(self.depth):
            at = np.where(features[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(
    features: np.ndarray,
    good: np.ndarray,
    constraints: Sequence[int],
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    smallest: int = 10,
    shrink: float = 1.0,
) -> Trees:
    """Fit by second-order boosting; with no rows, or rows of one kind only, every score is that of the base rate."""
    rows, n = len(features), max(len(features), 1)
    rate_good = min(max((float(good.sum()) + 0.5) / (n + 1), 1e-3), 1 - 1e-3)
    base = float(np.log(rate_good / (1 - rate_good)))
    if rows == 0 or good.min() == good.max():
        one = np.zeros(1)
        return Trees(one.astype(int), one, one.astype(int), one.astype(int), one, one.astype(int), 0, base, rows > 0)
    cuts = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in features.T]
    binned = np.stack([np.searchsorted(c, f, side="left") for c, f in zip(cuts, features.T)], axis=1)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots, margin = [], np.full(rows, base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + shrink), low, high))

    def gain(g, h, v):
        return -(g * v + 0.5 * (h + shrink) * v * v)

    def grow(which: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[which], hess[which]
        all_g, all_h = g.sum(), h.sum()
        value = leaf(all_g, all_h, low, high)
        place = len(nodes)
        nodes.append([0, 0.0, place, place, rate * value])
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f, direction in enumerate(constraints if level < depth and len(which) >= 2 * smallest else ()):
            size = len(cuts[f]) + 1
            if size < 2:
                continue
            b = binned[which, f]
            sums = [np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, np.ones(len(which)))]
            lv = np.clip(-sums[0] / (sums[1] + shrink), low, high)
            rv = np.clip(-(all_g - sums[0]) / (all_h - sums[1] + shrink), low, high)
            won = gain(sums[0], sums[1], lv) + gain(all_g - sums[0], all_h - sums[1], rv) - gain(all_g, all_h, value)
            allowed = (sums[2] >= smallest) & (len(which) - sums[2] >= smallest)
            if direction:
                allowed &= direction * (rv - lv) >= 0
            won = np.where(allowed, won, -np.inf)
            k = int(np.argmax(won))
            if won[k] > best[0]:
                best = (won[k], f, k, lv[k], rv[k])
        _, f, k, lv, rv = best
        if f >= 0:
            middle, direction = (lv + rv) / 2, constraints[f]
            sides = [(low, middle), (middle, high)] if direction > 0 else [(middle, high), (low, middle)] if direction < 0 else [(low, high)] * 2
            goes = binned[which, f] <= k
            left = grow(which[goes], level + 1, *sides[0])
            right = grow(which[~goes], level + 1, *sides[1])
            nodes[place] = [f, cuts[f][k], left, right, 0.0]
        else:
            margin_step[which] = rate * value
        return place

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess, margin_step = p - good, p * (1 - p), np.zeros(rows)
        roots.append(grow(np.arange(rows), 0, -np.inf, np.inf))
        margin = margin + margin_step
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots), depth, base)


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = 20_000) -> Trees:
    """Trees fitted to at most ``most_rows`` labelled ids, those with the smallest hash; labels that are null, or of no
    document, don't count.

    Ids labelled twice, or on several documents, count each time, within that number of rows; those of the smallest hash
    of id and text do, so reruns agree.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(label).cast("double").alias("good"))
    known = known.join(docs.select(F.col(id).alias("id")), "id", "left_semi")
    drawn = known.orderBy(F.xxhash64("id", F.lit("quality")), "id", "good").limit(most_rows)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")
    rows = rows.withColumns({"h": F.xxhash64("id", F.lit("quality")), "of_text": F.xxhash64("text")})
    described = annotated(rows, "text", "features array<double>", lambda texts: {"features": [statistics(t)[1] for t in texts]}, keep=["h", "id", "good", "of_text"])
    first = described.orderBy("h", "id", "good", "of_text").limit(most_rows).collect()
    found = sorted((r["id"], r["good"], tuple(r["features"])) for r in first)
    features = np.array([r[2] for r in found]).reshape(-1, len(FEATURES))
    return fit_trees(features, np.array([r[1] for r in found]), list(FEATURES.values()))


def with_quality(
    docs: DataFrame,
    trees: Trees,
    text: str = "text",
    threshold: float = 0.5,
    keep: Sequence[str] | None = None,
    only_kept: bool = False,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``STATISTICS``, ``score``, ``base_failed`` (fewer than 50 words, or over half of them in repeated
    windows of three) and ``kept``: not failed, and a score of at least ``threshold``. With trees that no label taught,
    documents are kept that have not failed, whatever the score.

    Null and empty texts fail. Rows are judged one by one, so repeated rows agree; other columns are handed on (those
    named in ``keep``, or all), and columns of ``docs`` with the names of the results, before which ``prefix`` is put,
    are replaced.
    """

    def describe(texts: list[str | None]) -> dict[str, Sequence]:
        found = [statistics(t) for t in texts]
        counted = np.array([f[0] for f in found], np.int64).reshape(-1, len(STATISTICS))
        score = trees.scores(np.array([f[1] for f in found]).reshape(-1, len(FEATURES)))
        failed = (counted[:, 0] < 50) | (100 * counted[:, 4] > 50 * counted[:, 0])
        columns = dict(zip(STATISTICS, counted.T))
        columns |= {"score": score, "base_failed": failed, "kept": ~failed & ((score >= threshold) | (not trees.taught))}
        return {prefix + name: column for name, column in columns.items()}

    kinds = dict.fromkeys(STATISTICS, "long") | {"score": "double", "base_failed": "boolean", "kept": "boolean"}
    ddl = ", ".join(f"`{prefix}{name}` {kind}" for name, kind in kinds.items())
    return annotated(docs, text, ddl, describe, keep, only=f"{prefix}kept" if only_kept else None)


@query("op7_quality_trees")
def op7_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trees = fit_quality(docs, table(spark, folder, "labels"))
    judged = with_quality(docs, trees, keep=["doc_id"])
    return judged.select("doc_id", *STATISTICS, "base_failed", "kept", "score")
