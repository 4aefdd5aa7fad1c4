from __future__ import annotations

import pytest

from parcelwatch.llm.common import prepare


@pytest.fixture(scope="session")
def corpus(spark):
    """A function that makes a documents table; missing columns are null."""
    prepare(spark)

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


#: Texts every operator must stand: null, empty, blank, very long, repeated.
ODD = [None, "", " \n\t ", "word", "a " * 60_000, "x" * 200_000, "same text here", "same text here", "1٢ ñ\U0001f600 &amp; <b>"]


@pytest.fixture(scope="session")
def odd(corpus):
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(ODD)]
    return corpus([*rows, (None, "no id", "en", "s"), (6, "same text here", None, None)])


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus([])
