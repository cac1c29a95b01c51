import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string, id string, row string, fp string"


def documents(rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names operators use themselves."""
    return [(i, t, lang, source, None if t is None else len(t), "k", "s", "x", "i", "r", "f") for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(documents(rows), SCHEMA)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGES = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a"),
    (2, "The  cat sat\ton the mat and looked at the dog.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, None, "de", "b"),
    (6, " \n\t", "fr", None),
    (7, "The cat sat on the mat and looked at the dog.", "en", None),
    (7, "The cat sat on the mat and looked at the dog.", "en", None),
    (8, "one two", "es", "c"),
    (9, "ein und der die das ist nicht auf", "de", "c"),
    (10, LONG, "en", "c"),
    (11, LONG, "en", "c"),
    (None, "no id at all here", "en", "a"),
    (12, "émoji 🙂 ▁ under\x00zero   line", "fr", "a"),
    (13, "9 8 7 6", None, "a"),
]


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
