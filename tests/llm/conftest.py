"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

CLASHING = "id bigint, n bigint, row string, key string, hull string, size int, c int, h int, v int, sha string, score double, body string, n_entities string"
CLASH = (1, 2, "r", "k", "h", 3, 4, 5, 6, "s", 0.5, "b", "e")


def prose(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "über", "été", "naïve", "omega", "sigma", "tau", "pi", "rho"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (0, base, "en", "a"),
        (1, base, "en", "a"),
        (1, base, "en", "a"),  # a repeated row
        (2, near, "en", "b"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, " \t\n ", "en", None),
        (None, base + " tail", "en", "c"),
        (None, "one two", "en", "c"),
        (6, "One  TWO", "en", "c"),
        (7, "x", "en", ""),
        (8, "line\nline\nline\n" + prose(rng, 30), "de", "a"),
        (9, prose(rng, 6000), "fr", "a"),
        (10, "😀 İstanbul ΣΑΣ é é     <|endoftext|> it's", "el", "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    schema = "doc_id bigint, text string, lang string, source string, " + CLASHING
    return spark.createDataFrame([(*r, *CLASH) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
