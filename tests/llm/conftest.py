import pytest


@pytest.fixture()
def docs(spark):
    """Make a documents table of (doc_id, text[, source[, lang]]) rows."""

    def make(rows):
        full = [(*r, *([None] * (4 - len(r)))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string")

    return make
