import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, place long, words string, score double, bucket string"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice(["an", "er", "th", "io", "na", "es", "to", "ri", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]


@pytest.fixture(scope="session")
def edge_rows(vocabulary):
    """Nulls, empty and blank texts, one word, repeated rows, a very long text, a missing id, unusual characters."""
    rng = random.Random(2)
    texts = [None, "", "  \n\n \t", "word", "word", prose(rng, 40, vocabulary), "é ñ 日本 😀\x1c\x85 x", "=" * 300 + " " * 200 + "\n" * 50]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(50, prose(rng, 12_000, vocabulary)), (3, "word"), (None, "no id"), (60, None)]
    return [(i, t, "en", None, len(t or ""), 7, 7, "w", 0.5, "b") for i, t in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 7, "w", 0.5, "b") for i, t in rows], SCHEMA)
