import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls in each column, empty and blank texts, ties, repeated rows, other alphabets.
ODD = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, "   \n\n ", None, None, 6),
    (4, "One two three.", "en", "b", 14),
    (4, "One two three.", "en", "b", 14),
    (5, "One two three.", "en", None, 14),
    (6, "é ü ñ İK 😀 " * 40, "fr", "b", 480),
    (7, "x" * 5000, "en", "c", 5000),
    (8, "a\nb\nc\nd\n" * 30, "en", "c", 240),
    (None, "No id here, none at all.", "en", "c", 24),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """Columns that operators use or add themselves, also in other cases."""
    from pyspark.sql import functions as F

    names = ["k1", "K2", "score", "n_words", "items", "place", "shard", "slot", "part", "gone", "spans", "rid_", "label", "h", "found"]
    return odd.withColumns({n: F.lit(n) for n in names})


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset((b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else ())
