import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, and columns with clashing names."""
    long = "".join(f"w{i} " for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta " * 30, "en", "a"), (1, "alpha beta gamma delta " * 30, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n ", "en", "b"),
        (5, long, "de", "a"), (None, "some words here", "en", "c"), (6, "ünïcode wörds ß " * 40, "de", "c"), (7, "one", "fr", None), (8, "\U0001f600 emoji only", "fr", "b"),
    ]
    return spark.createDataFrame([(*r, 9, 9, 9, "x", 1.5, 7, 8, "r") for r in rows], "doc_id long, text string, lang string, source string, shard int, size long, n_words long, fp string, key double, whole int, cut int, row string")


@pytest.fixture
def none(odd):
    return odd.limit(0)
