import pytest

#: Columns beside doc_id and text that clash with the operators' own names.
EXTRA = "lang string, source string, n_chars long, key string, fp long, __fp string, component_id long, n_words string, digest long, kept string"


@pytest.fixture()
def corpus(spark):
    """Make documents from (doc_id, text) pairs, with clashing extra columns full of nulls."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, "x", 7, "y", None, "z", 3, "w") for i, t in rows], "doc_id long, text string, " + EXTRA)

    return make


@pytest.fixture()
def odd(corpus):
    """Null ids and texts, empty, blank and long texts, repeated rows."""
    long_text = " ".join(f"w{i % 4000}" for i in range(30_000))
    return corpus([(1, None), (2, ""), (3, " \t\n"), (None, "a null id"), (None, None), (5, "same row"), (5, "same row"), (6, "same row"), (7, long_text), (8, "one")])


@pytest.fixture()
def real(spark):
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    return spark.read.parquet(path)
