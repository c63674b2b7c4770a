import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns whose names clash with results."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows],
                                     "doc_id long, text string, key string, fp string, n_words int, score string")
    return make
