import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """A hundred-odd real rows of the smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and clashing extra columns."""
    long_text = "wide words in a long row " * 20_000
    rows = [
        (1, None, "en", "a", 5), (2, "", None, "a", None), (3, " \t\n", "en", None, 3), (4, long_text, "en", "a", 9), (4, long_text, "en", "a", 9),
        (5, "same text here", "de", "b", 14), (6, "same  text\there", "de", "c", 15), (None, "same text here", None, "b", 14), (7, None, None, None, None),
        (8, "12 34 !!", "fr", "b", 8), (9, "one", "fr", "b", 3), (4, "other text under an id used before", "en", "c", 2), (10, "ünïcödé 中文 😀 Σς", "de", "b", 4),
    ]
    extra = ["h", "norm", "fp", "rep", "score", "pos", "n", "words", "key", "line", "token", "size", "kept", "component_id"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(extra)))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
