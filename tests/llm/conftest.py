import random

import pytest

SCHEMA = "doc_id long, text string, lang string, row long, v string, key string, T1 int, n_chars long"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = words(rng, 30_000)
    base = words(rng, 80)
    rows = [
        (1, None, None), (2, "", "en"), (None, "a text without an id", "en"), (None, None, None), (3, "   \n \t", "en"),
        (4, base, "en"), (5, base, "de"), (5, base, "de"), (6, base + " tail", "en"), (7, long, "en"), (8, "one", None), (8, "other", "en"),
        (9, "line a\nline b\nline c\nline d", "en"), (10, "line x\nline b\nline c\nline d\nlast", "en"), (11, "é ß 你好 🎉 ÿ\r\nnext\u00a0one", "fr"),
        (12, "12 34 !!", "en"), (-3, "x" * 50_000, "en"),
    ]
    return [(i, t, g, 7, None, "k", None, len(t) if t else None) for i, t, g in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
