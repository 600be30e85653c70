import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1, "x", "y"),
        (2, "one two three four five six seven eight nine ten eleven", "en", "a", 1, "x", "y"),
        (2, "one two three four five six seven eight nine ten eleven", "en", "a", 1, "x", "y"),
        (3, "one  two\tthree four\nfive six seven eight nine ten eleven", "en", None, 1, None, None),
        (4, None, None, None, None, None, None),
        (5, "", "en", "a", 0, "x", "y"),
        (6, " \n\t ", "en", "a", 4, "x", "y"),
        (None, "a text without an id", "en", "a", 1, "x", "y"),
        (None, "a text without an id", "en", "a", 1, "x", "y"),
        (7, "word " * 30_000, "en", "a", 1, "x", "y"),
        (8, "été über ñandú 日本語 😀 " * 50, "fr", "a", 1, "x", "y"),
        (9, "x" * 5000, "en", "a", 1, "x", "y"),
        (10, "Short", "en", "a", 1, "x", "y"),
        (11, "123 456 !!!", None, "a", 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf0001):
    return spark.read.parquet(f"{sf0001}/documents.parquet")
