import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("th", "ou", "er", "in") for b in ("an", "re", "st") for c in ("ed", "le", "or", "is", "um")]


@pytest.fixture(scope="session")
def prose():
    """Reproducible words; ``prose(seed, n)`` gives a list of n."""
    return lambda seed, n: random.Random(seed).choices(WORDS, k=n)


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text) rows, in three partitions, with a clashing column."""

    def make(rows, extra=""):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, DOCUMENTS)
        return df.repartition(3) if rows else df

    return make
