import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, node long, key long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[(i * i) % 12] + str(i % 97) for i in range(30_000))
    base = " ".join(words[i % 12] + str(i) for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", None, None), (4, None, "en", "a"), (5, "", None, "b"),
        (6, "   \n\t", "de", "b"), (7, long, "en", "b"), (8, "two words", "en", None), (9, "two words", "de", "c"), (None, "no id here at all", "en", "c"), (10, "12345 678", "en", "c"), (11, "naïve café ☕ \U0001f600", "fr", "c"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", 0.5, 1, 2) for i, t, g, s in rows], SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
