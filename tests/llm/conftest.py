import pytest


@pytest.fixture()
def documents(spark):
    """A function from rows (doc_id, text) to a documents table with a clashing extra column for each name we use."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, sig string, h1 string, n long, own_text string"
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 0.0, "x", "y", "z", 1, None) for i, t in rows], schema)

    return make
