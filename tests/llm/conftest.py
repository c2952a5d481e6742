import random

import pytest

WORDS = "alpha bravo delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu the of and to in".split()


@pytest.fixture
def prose():
    """Function that gives n random words."""
    rng = random.Random(7)
    return lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + str(rng.randint(0, 99)) * rng.randint(0, 1) for _ in range(n))


@pytest.fixture
def odd_docs(spark, prose):
    """Nulls in any column, empty and very long texts, repeated rows, and columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, h long, bucket int, id long, rep long, n int"
    long_text = prose(30_000)
    rows = [(1, None), (2, ""), (3, "   \n "), (None, "a text without an id"), (5, long_text), (6, long_text), (7, "ties"), (7, "ties"), (8, "ties"), (None, None), (9, ""), (10, prose(60))]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 1, 2, 3, 4, 5) for i, t in rows], schema)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
