import re

import pytest

WORDS = re.compile(r"[^\x00-\x2f:-@\[-`{-\x7f]+")


@pytest.fixture(scope="session")
def words():
    """The token rule, written again."""
    return lambda text: WORDS.findall((text or "").lower())


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, grams string, keep string, __x string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeats, ties, columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall green tree near the river bank"
    rows = [
        (1, base, "en", "a", 1, "g", "k", "x"),
        (2, base, "en", "a", 1, None, "k", "x"),
        (3, base + " tonight", "en", "a", 1, "g", None, "x"),
        (4, "", "en", "b", 0, "g", "k", "x"),
        (5, None, None, None, None, None, None, None),
        (6, " \n\t ", "en", "b", 3, "g", "k", "x"),
        (7, "word", "en", "b", 4, "g", "k", "x"),
        (8, "long " * 60_000 + "end", "en", "c/d/e", 300_003, "g", "k", "x"),
        (9, "unlike anything else here: crimson turbines hum beside frozen lakes and nobody hears them at noon", "en", "c/d/f", 90, "g", "k", "x"),
        (9, "unlike anything else here: crimson turbines hum beside frozen lakes and nobody hears them at noon", "en", "c/d/f", 90, "g", "k", "x"),
        (None, base, "en", "a", 1, "g", "k", "x"),
        (None, None, None, None, None, None, None, None),
        (10, "変数 é ß 🦀 ¡hola! l'été", "fr", "é", 20, "g", "k", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
