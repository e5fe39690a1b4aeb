from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """A small documents table with nulls, blanks, copies, a repeated row and a clashing extra column."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en" if (i or 0) % 2 else None, "s" if (i or 0) % 3 else None, len(t or ""), f"x{i}") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")

    return make
