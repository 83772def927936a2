import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    long_text = "word other thing\n" * 20_000 + "tail"
    rows = [
        (1, "a b c\nd\n\n", "en", "s1", 1), (1, "a b c\nd\n\n", "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "s2", 0),
        (None, "no id here", "de", "s1", 10), (None, None, None, None, None), (4, long_text, "en", "s2", len(long_text)),
        (5, " \t\x0b\x0c\r", "fr", "s1", 5), (6, "퟿ünï ©😀   x", "fr", "s3", 9), (7, "a b c\nd\n\n", "en", "s3", 8),
        (8, "12 34 !!", None, "s3", 8),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Columns that clash by case, and with what operators name theirs.
    return df.select("*", *[F.lit(1).alias(c) for c in ("TEXT", "Doc_Id", "tk", "score", "spans", "size", "key", "fp", "word", "pos", "n")])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
