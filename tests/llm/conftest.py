import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text, lang, source) rows, with a clashing column."""
    def make(rows, extra="score"):
        return spark.createDataFrame(
            [(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in rows],
            f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra} string")

    return make
