import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.join(os.path.dirname(os.path.dirname(HERE)), "tools")]

from conftest_llm import SF  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def _importable(spark):
    from cellframe.llm.registry import importable

    importable(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, equal texts, and columns with names that operators use themselves."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (None, None, None, None),
        (None, "no id here " + words, "en", None),
        (1, "", "en", "a"),
        (2, None, "de", "a"),
        (3, " \n\t ", "de", "b"),
        (4, words, None, "b"),
        (4, words, None, "b"),
        (5, words, "en", "a"),
        (6, "1234 ... !!!", "en", "é"),
        (7, (words + "\n") * 4000, "fr", "a"),
        (8, "naïve Äpfel 中文 😀 don't  two  spaces\r\n", "de", "b"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("score", "kept", "fp", "n", "size", "taken", "shard", "ids", "id", "h", "part", "target", "root", "b", "doc.id", "a b"):
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    return frame.cache()

