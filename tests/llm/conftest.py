import pytest

LONG = " ".join(f"word{i % 977} thing{i % 31}." for i in range(15_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, key string, shard string, rejected string"


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with everything that may go wrong: nulls, empty and long texts, ties, repeats, clashing names."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it at once", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from it at once", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from it at once", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n ", "de", "b"),
        (6, "12345 !!! ???", "de", "b"),
        (None, "a row without a number but with some words of its own to keep", "fr", None),
        (None, None, None, None),
        (7, LONG, "en", "a"),
        (8, "short", None, "c"),
        (8, "another text with the same number as the one before it", "en", "c"),
        (9, "Der schnelle braune Fuchs springt über den faulen Hund ﬁnß 日本語 \U0001f600", "de", "b"),
    ]
    return [(i, t, g, s, len(t) if t is not None else None, 7, "r", "k", "x", "no") for i, t, g, s in texts]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
