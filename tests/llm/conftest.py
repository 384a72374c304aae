"""Rows that every corpus operator must bear."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, row string, key_id string, n_words string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null ids, repeated rows, a long text, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and" for i in range(60_000))
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "One two three.", "en", "a"),
        (3, "One two three.", "en", "a"),
        (None, "no id here", "fr", None),
        (4, long_text, "en", "b"),
        (5, "\n\n \t", None, "b"),
        (6, "Él está aquí ¿no? 日本語 🎉", "es", "b"),
    ]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
