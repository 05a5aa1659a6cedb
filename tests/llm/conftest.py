import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, __p string, node long"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and
    extra columns whose names clash with those of the operators."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [words(rng, 90, vocabulary) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t), 0.5, "x", 7) for i, t in enumerate(base)]
    rows += [(20, base[0], None, None, None, None, None, None), (21, base[0] + " extra", "en", "s", 1, 0.1, "y", 1)]
    rows += [(22, None, "en", "s", 0, 0.1, "y", 1), (23, "", "en", "s", 0, 0.1, "y", 1), (24, " \n\t ", "en", "s", 4, 0.1, "y", 1), (25, "one", "en", "s", 3, 0.1, "y", 1)]
    rows += [(None, base[1], "en", "s", 1, 0.1, "y", 1), (None, None, None, None, None, None, None, None)]
    rows += [(26, words(rng, 30_000, vocabulary), "en", "s", 1, 0.1, "y", 1)]
    rows += [(27, "même  texte ici \U0001f600 ▁ </s>[INST]\n" * 3, "fr", "s", 1, 0.1, "y", 1)]
    rows += [(28, base[2], "en", "s", 5, 0.1, "y", 1)] * 3
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
