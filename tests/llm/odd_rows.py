"""Documents that try what operators must stand; fixtures for the tests of this folder."""

from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet consetetur " * 20_000 + "x" * 300_000

#: (doc_id, text): nulls, empty and blank texts, ties, repeated rows, a very long text, odd characters.
TRICKY = [
    (1, "The quick brown fox jumps over the lazy dog again and again"),
    (2, "the QUICK brown fox jumps over the lazy dog again and again"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one"),
    (7, "One"),
    (8, "Ärger und Übel 12   \U0001f600 \x1c\x85 ÉÈ"),
    (9, LONG),
    (10, LONG.upper()),
    (11, "1234 4111 1111 1111 1111 call +1 (555) 010-9999 a.b@c.example.org 10.0.0.255 256.1.1.1"),
    (11, "1234 4111 1111 1111 1111 call +1 (555) 010-9999 a.b@c.example.org 10.0.0.255 256.1.1.1"),
    (None, "the quick brown fox jumps over the lazy dog again and again"),
    (None, None),
    (12, "a b a b a b a b"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """The odd documents with columns whose names an operator could use itself."""
    rows = [(i, t, None if k % 3 == 0 else "en", "src", 7, "mine", 0.5, 1, b"x") for k, (i, t) in enumerate(TRICKY)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score double, label int, sha binary"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, tricky):
    return spark.createDataFrame([], tricky.schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

