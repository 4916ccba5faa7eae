import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, an extra column with a clashing name."""
    base = " ".join(f"w{i % 97}x{i}" for i in range(60))
    rows = [
        (1, None, "en", None, None, "a"), (2, "", None, "s", 0, "b"), (3, base, "en", "s", 1, None), (4, base, "en", "s", 1, "c"),
        (5, base + " tail one two", "en", None, 1, "d"), (6, " \t\n ", "de", "s", 1, "e"), (7, "a " * 40_000, "en", "s", 1, "f"),
        (8, "x" * 30_000, "en", "s", 1, "g"), (9, "one\n\ntwo  three four   é'll it's", "en", "s", 1, "h"),
        (9, "one\n\ntwo  three four   é'll it's", "en", "s", 1, "h"), (None, base, "en", "s", 1, "i"),
        (10, "\x00" * 300 + base, None, "s", 1, "j"), (11, "12345 ### --- <|endoftext|>", "en", "s", 1, "k"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, anchor string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
