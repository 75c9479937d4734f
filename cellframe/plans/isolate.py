"""Applying a batch of items of which some may fail: halved until the failing ones are alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cellframe.operators.prefix import in_order, running
from cellframe.session import durable

#: Characters of an error's text that are kept.
REASON_LENGTH = 500


class TooManyFailures(RuntimeError):
    """So many items fail that the fault is hardly theirs."""


@dataclass(frozen=True)
class Failure:
    """An item that failed alone, ``attempts`` times, and what it failed with at last."""

    key: object
    attempts: int
    reason: str


def reason_of(error: Exception) -> str:
    """The first line of an error's text that says something."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    return (lines[0] if lines else type(error).__name__)[:REASON_LENGTH]


def apply_apart(
    items: DataFrame, key: str, apply: Callable[[DataFrame], object], attempts: int = 2, most_failures: int = 100
) -> list[Failure]:
    """Call ``apply`` with the items, or with parts of them so that each item is in one call that succeeds or fails alone.

    ``key`` is unique and not null. A call that fails is made again ``attempts - 1`` times, in case the fault was not the
    items'; then the items are halved by the order of their keys and both halves go the same way. One failing item among
    n costs about 2 * log2(n) further calls. ``apply`` must bear being called again with items it was called with before.
    Only numbers of items and the failures themselves, ``most_failures`` at most, come to the driver; beyond that
    :class:`TooManyFailures` is raised, since nothing would be left of the batch.
    """
    failures: list[Failure] = []
    error = _attempted(items, apply, attempts)
    if error is None:
        return failures
    numbered = durable(running(in_order(items, [key]), number=F.lit(1)).drop("range!", "place!"), "numbered")
    parts = [(0, numbered.count(), error)]
    while parts:
        first, last, error = parts.pop()
        if last - first <= 1:
            if last > first:
                alone = numbered.filter(F.col("number") == first).select(key).first()
                failures.append(Failure(alone[0], attempts, reason_of(error)))
            if len(failures) > most_failures:
                raise TooManyFailures(f"more than {most_failures} items failed, the last one with: {reason_of(error)}") from error
            continue
        middle = (first + last) // 2
        for a, b in ((middle, last), (first, middle)):
            part = numbered.filter((F.col("number") >= a) & (F.col("number") < b)).drop("number")
            again = _attempted(part, apply, attempts)
            if again is not None:
                parts.append((a, b, again))
    return failures


def _attempted(items: DataFrame, apply: Callable[[DataFrame], object], attempts: int) -> Exception | None:
    error = None
    for _ in range(max(1, attempts)):
        try:
            apply(items)
            return None
        except Exception as found:  # whatever it is, it is handed on: as a failure, or raised with too many others
            error = found
    return error
