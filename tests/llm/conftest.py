import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, node string, codes string, bucket int, seed long, range int, spans string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 2, 3, "z") for i, t in rows], schema)

    return make
