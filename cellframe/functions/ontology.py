"""Ontology terms such as ``UBERON:0000955`` or ``UBERON:0000955 (organoid)``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MARKED = r"^(.*)( \(.*\))"


def mark(term: Column) -> Column:
    """The trailing remark in brackets, with its blank; empty when there is none."""
    return F.regexp_extract(term, _MARKED, 2)


def plain(term: Column) -> Column:
    """The term as ``prefix:accession`` without remark; null when it has neither one colon nor one underscore."""
    by_colon, by_underscore = F.split(term, ":"), F.split(term, "_")
    pair = F.when(F.size(by_colon) == 2, by_colon).when(F.size(by_underscore) == 2, by_underscore)
    accession = F.get(pair, F.lit(1))
    bare = F.when(mark(accession) != "", F.regexp_extract(accession, _MARKED, 1)).otherwise(accession)
    return F.concat(F.get(pair, F.lit(0)), F.lit(":"), bare)
