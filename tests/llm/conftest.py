import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with exact, near and partial copies, ties, nulls, empty and long texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[3], texts[3].upper(), texts[4], texts[4] + " more", texts[5] + " " + texts[6], None, "", None, "  \n ", "é ü " + texts[7], texts[8][: len(texts[8]) // 2] + texts[9]]
    edited = texts[10].split()
    edited[len(edited) // 2 :] = [*edited[len(edited) // 2 :], "x"]
    texts += [" ".join(edited), prose(rng, 6000), "a " * 80, "a " * 81, "the same line\nanother line of text here\nthe same line", "another line of text herd\n\nother"]
    return [(i * 3 % 1000, t, "en", ["s1", "s2", "s3", None][i % 4]) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and extra columns with names that operators use themselves."""
    rows = [(None, "some words that are here for everyone to read now", "en", "a", 1, "x"), (1, "b c d", "en", "a", 2, "x"), (1, "b c d", "en", "a", 2, "x"), (1, "other text", "en", None, 3, "y"), (2, "b c d", None, "a", None, None), (3, None, "en", "a", 4, "z")]
    return spark.createDataFrame(rows, SCHEMA + ", fp long, kept string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
