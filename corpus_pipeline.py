"""From raw documents to packed sequences: quality, language, near duplicates, mixture, packing.

Every stage works on all that its predecessor kept. The stages before the last return rows with the columns of
documents; the last returns the pieces of the packed sequences with their token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellframe.llm.encode import default_tokenizer
from cellframe.llm.frames import quoted, table, word_count
from cellframe.llm.langid import fit_profiles, with_language
from cellframe.llm.mixing import mix, mixed_documents
from cellframe.llm.packing import pack
from cellframe.llm.quality import fit_quality, with_quality
from cellframe.llm.registry import importable
from cellframe.llm.simhash import deduplicated
from cellframe.session import durable

#: Documents less like their nearest language's profile than this have no language that is known.
LEAST_LIKENESS = 0.3
#: What sources weigh in the mixture, in turn.
WEIGHTS = (5, 2, 1)
END_ID = 1
#: Fingerprints of near copies differ in no more bits.
MOST_BITS = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep.

    Null, empty and wordless texts fail the base rules and go. Long texts are read whole, repeated rows are judged
    alike, a score at the threshold is kept, and without labels the base rules decide alone. An empty table stays
    empty; columns of any other name are handed on.
    """
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs, trees, only_kept=True, prefix="quality!").select(*quoted(docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Null texts and texts without a letter go, and all go where no document has a language. Of languages at the same
    distance the first by code points counts, which changes nothing here. Long texts are read whole, repeated rows are
    judged alike, an empty table stays empty, columns of any other name are handed on.
    """
    return with_language(docs, fit_profiles(docs), reject_below=LEAST_LIKENESS, prefix="language!").select(*quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints of four-word shingles link at four or fewer bits.

    The document of the smallest id stays (null ids last, then the smallest hash of the text); of repeated rows one.
    Null, empty and wordless texts have the fingerprint 0 and are linked like any other. Long texts are read whole, an
    empty table stays empty, columns of any other name are handed on.
    """
    return deduplicated(docs, radius=MOST_BITS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, twice at most, the last one of a shard whole or not at all.

    That one is taken when at least half of its words are. Texts without words are never taken. A null source is a source of
    its own, null ids share a place in the order, repeated rows follow one another. Long texts are never cut, an empty
    table stays empty, columns of any other name are handed on.
    """
    sized = docs.withColumn("words!", word_count(F.col("text")))
    return mixed_documents(mix(sized, WEIGHTS, size="words!", prefix="mix!"), size="words!", prefix="mix!", whole=True).select(*quoted(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 ids, in which each source has its share of every window.

    Null and empty texts have their end id alone. Long texts are cut into pieces and lose nothing, repeated rows are
    documents of their own, pieces that end in the same round follow by source and place. An empty table gives no
    pieces; other columns are not read.
    """
    return pack(docs, default_tokenizer(), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

ORACLE_SQL = None  # trees, profiles, fingerprints and token ids have no SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
