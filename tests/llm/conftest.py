import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, removed BIGINT, fp STRING, label STRING, word STRING"


@pytest.fixture
def docs(spark):
    """Build documents with NULLs where nothing is said and extra columns whose names operators use inside."""

    def make(rows, schema=DOCS):
        filled = [(i, t, "en", "s", None if t is None else len(t), 7, "x", "y", "z") for i, t in rows]
        return spark.createDataFrame(filled, schema)

    return make
