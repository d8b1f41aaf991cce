import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text[, lang[, source]]) rows."""

    def make(*rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
