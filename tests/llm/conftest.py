import random

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def prose():
    """A maker of seeded prose."""

    def make(seed, words, names=800):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(names):x}" for _ in range(words))

    return make


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "The same text of a few words stands here twice and it is long enough to be found again.", "en", "s", 1, "x"),
        (2, "The same text of a few words stands here twice and it is long enough to be found again.", "en", None, 2, "x"),
        (2, "The same text of a few words stands here twice and it is long enough to be found again.", "en", None, 2, "x"),
        (3, None, "fr", "s", None, None), (4, "", None, "t", 0, "y"), (5, "x" * 300_000, "de", "t", 300_000, "y"),
        (6, "é" * 100 + " cc-by " + "all rights  reserved " * 3, "fr", "s", 5, "z"), (None, "A row without an id has a text too.", "en", "s", 5, "z"),
        (7, "1234 5678 !!", "es", "s", 5, "z"), (8, "\t\n ", "es", "u", 3, "z"),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long, h string"
    return spark.createDataFrame(rows, cols).selectExpr("*", "h AS i", "h AS t", "h AS p", "h AS kept", "h AS r")
