import pytest

LONG = "word, other. " * 9000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an extra column."""
    rows = [
        (1, "Plain text here, with words.\nAnd a second line.", "en", "a", 10, "x"),
        (2, None, "en", None, None, None),
        (3, "", None, "a", 0, "x"),
        (4, LONG, "en", "a", 7, "x"),
        (5, "Plain text here, with words.\nAnd a second line.", "en", "b", 10, "y"),
        (5, "Plain text here, with words.\nAnd a second line.", "en", "b", 10, "y"),
        (6, "x  y \t z\n\n\n<|endoftext|> ... ,,a é.ñ  don't.", "fr", "b", 10, "y"),
        (7, "A" * 5000, None, "b", 10, "y"),
        (8, "***!!! 😀 \u0000", "de", "b", 10, "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sequence_id string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
