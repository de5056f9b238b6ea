import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("_row", T.StringType()),
        T.StructField("_id", T.LongType()),
        T.StructField("lines", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)


def row(doc, text, source="a", lang="en"):
    return (doc, text, lang, source, None if text is None else len(text), "r", 1, "l", 2, 3, 4)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table with extra columns of clashing names from (doc_id, text[, source]) tuples."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)


LONG = "\n".join(f"line {i} of a very long text with the number {i * i} in it." for i in range(6000))
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t\n"),
    (None, "a text without an id, but with some words in it"),
    (4, "same text in two rows of one id"),
    (4, "same text in two rows of one id"),
    (5, LONG),
    (6, "äöü ñ ç 漢字 🙂 mixed\x0bwhite\x1fspace here", None),
    (7, "one"),
    (8, "two words", "b"),
    (9, "a" * 200_000),
    (10, " " * 50_000),
]


@pytest.fixture(scope="session")
def odd(documents):
    """Null ids, texts and sources, blank, repeated and very long texts, and clashing column names."""
    return documents(ODD)


@pytest.fixture(scope="session")
def none(documents):
    return documents([])
