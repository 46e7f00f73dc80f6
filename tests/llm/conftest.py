import pytest


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text) as a table, with columns of names that operators use themselves."""

    def make(rows):
        rows = [(i, t, 7, "x", 1.5) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, kept string, score double").repartition(3)

    return make
