"""Tables of odd rows: nulls, empty and long texts, repeated rows, clashing names, no rows at all."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, path string, fp long, rest string, _s string, _h string, _block int, pass string, `a.b` string, __drop long, row string, node long"


@pytest.fixture(scope="session")
def odd(spark):
    long_text = "alpha beta gamma delta " * 40_000
    rows = [
        (1, "one two three four five", "en", "a"),
        (1, "one two three four five", "en", "a"),  # a repeated row
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "de", "a"),
        (None, "an id is missing here", "en", "b"),
        (6, long_text, "en", "a"),
        (7, "One two THREE four five", None, "b"),
        (8, "one two three four five", "fr", None),
        (9, "##### $$$ %%% <|endoftext|> 日本語 \u00a0 x", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, 0.5, "p", 7, "r", "s1", "h1", 5, "p1", "dot", 9, "w", 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
