import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, size string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long_text = "lorem ipsum dolor " * 40_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 5, 0.1, 1, "x"),
        (2, "the QUICK brown fox jumps over the lazy dog and runs away", "en", "a", 5, None, 1, "x"),
        (2, "the QUICK brown fox jumps over the lazy dog and runs away", "en", "a", 5, None, 1, "x"),
        (3, "", "en", "b", 0, 0.1, 1, None),
        (4, None, None, None, None, None, None, None),
        (5, long_text, "de", "b", 7, 0.0, 2, "y"),
        (6, " \t\n ", "fr", None, 1, 0.0, 2, "y"),
        (None, "no id at all here, just words", "en", "c", 1, 0.0, 2, "y"),
        (7, "Zürich 東京 \\ [INST] 😀 naïve", "en", "c", 1, 0.0, 2, "y"),
        (8, "one", "en", "c", 1, 0.0, 2, "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 0, None), (None, 1, 1), (7, None, 1), (8, 5, 9)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def as_rows(df):
    return [r.asDict() for r in df.collect()]
