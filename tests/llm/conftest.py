from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, score double"
A = "the quick brown fox jumps over the lazy dog and runs far away from here "


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with names that operators use inside."""
    rows = [
        (1, A * 3, "en", "a", 1, 1, 0.1), (2, A * 3, "en", "a", 1, 1, 0.1), (2, A * 3, "en", "a", 1, 1, 0.1), (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 2, 0.0), (None, "no key here, mail me@site.org", "fr", None, 5, 3, 0.5), (6, " \t\n ", "en", "b", 3, 4, 0.2),
        (7, "12 34 !!", None, "a", 8, 5, 0.3), (8, A * 3000, "en", "a", 0, 6, 0.4), (9, "x" * 5000, "de", "c", 0, 7, 0.4), (10, "é", "fr", "c", 1, 8, 0.4),
        (11, "one two", "en", "a", 7, 9, 0.9), (12, "One  TWO", "en", "a", 8, 9, 0.9), (13, "😀 \x1c odd line <|endoftext|> x", "en", "c", 0, 1, 0.0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
