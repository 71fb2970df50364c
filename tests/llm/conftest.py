from __future__ import annotations

import pytest

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_words", T.StringType()),  # clashes with an output column
        T.StructField("key", T.StringType()),
    ]
)


def rows_of(*items):
    """(doc_id, text, source) to rows of DOCS."""
    return [(d, t, "en", s, len(t or ""), "x", "k") for d, t, s in items]


def words(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéñüstr") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, long, repeated, and clashing columns."""
    long_text = words(1, 30_000)
    shared = words(2, 60)
    items = [
        (1, words(3, 80) + " " + shared, "a"), (2, words(4, 80) + "\n" + shared + "\n" + words(5, 30), "a"),
        (2, words(4, 80) + "\n" + shared + "\n" + words(5, 30), "a"), (3, None, "a"), (4, "", None), (None, shared, "b"),
        (None, None, None), (5, " \n\t ", "b"), (6, long_text, "b"), (7, shared + " " + shared, "c"), (8, "One", "c"),
        (9, long_text + " tail", "c"), (2, "same id other text " + shared, "c"), (10, "ÀB àb x" * 30, "c"),
    ]
    return spark.createDataFrame(rows_of(*items), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    """The documents, pages and conversations of the smallest driver tables."""
    return "/root/testdata/sf0.001"
