import pytest
from pyspark.sql import functions as F

NASTY = [
    (1, "The quick brown fox jumps over the lazy dog. " * 6, "en", "a", 270),
    (1, "The quick brown fox jumps over the lazy dog. " * 6, "en", "a", 270),      # a repeated row
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "no id, but some words of text here", "en", "b", 34),
    (4, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (5, "one", "fr", "b", 3),
    (6, "word%d " * 3 + " ".join(f"w{i}" for i in range(30_000)), "en", "c", None),   # very long
    (7, "The Quick Brown Fox jumps over the lazy dog. " * 6, "de", None, 270),
    (8, "é ü   ñ 漢字   ſecret K", "fr", "c", 20),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    df = spark.createDataFrame(NASTY, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"size": F.lit("x"), "score": F.lit("y"), "fp": F.lit("z"), "y": F.lit(1),
                           "key": F.lit(2), "w": F.lit(3), "shard": F.lit(4), "item_id": F.lit(5),
                           "held_out": F.lit("h"), "token": F.lit("t"), "root": F.lit("r")})


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.where("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def documents_mid(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
