from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (ids count up) or (id, text) pairs."""
    def make(*texts):
        rows = [(n, t) if not isinstance(t, tuple) else t for n, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs, spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long word and a long text."""
    long_text = " ".join(f"w{n % 997}" for n in range(60_000))
    docs = make_docs((1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "one two three"), (None, None),
                     (5, long_text), (6, "x" * 200_000), (7, "\u0000 ퟿ é"))
    return docs.unionByName(spark.createDataFrame([(8, "a b c", None, None, None)], docs.schema))
