import random

import pytest

WORDS = [a + b for a in ("ta", "re", "mi", "so", "lun", "ker", "vo") for b in ("n", "ra", "del", "ist", "o", "um")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and columns whose names operators use inside."""
    rng = random.Random(1)
    long = prose(rng, 20_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, None), (None, "some words here"), (5, long), (6, long), (6, long), (7, "taé \U0001f600 " * 30), (8, prose(rng, 60)), (8, prose(rng, 60))]
    made = [(i, t, "en", None if k % 3 else "src", None if t is None else len(t), 1, 2, "x", 4) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score long, row long, base string, sid long").repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
