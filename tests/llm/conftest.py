import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, ids string, spans string, score double, label int"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, unusual characters."""
    rng = random.Random(7)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma", "delta;", "ééé", "日本語", "x1"]) for _ in range(30_000))
    texts = [
        (1, "Same text, Twice"), (2, "same TEXT, twice"), (3, ""), (4, None), (None, "no id"), (None, None), (5, "  \n\t "), (6, long), (7, long.upper()), (8, "A\x00B \x1c É ſ K"),
        (9, "dup id"), (9, "dup id"), (9, "dup id, other text"), (10, "\U0001f600 emoji \U0001f600"), (11, "a b c"), (12, "A  b\nc"), (13, "x" * 5000), (14, "don't we'll I'm 1234 !!! <|endoftext|>"),
    ]
    return [(i, t, None if k % 2 else "en", None if k % 3 else "s", None if k % 4 else k, k, "x", "y", 0.5, 1) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
