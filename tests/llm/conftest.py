import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "sa", "ri", "vo") for b in ("r", "nt", "s", "del", "mo", "ba", "")]


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def prose():
    def build(words, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words))

    return build


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, source) as a table with further columns whose names clash with common ones."""

    def build(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, "x") for i, t, s in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, size long, _id string"
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and white texts, repeated rows, ties and a very long text."""
    long_text = prose(40_000, 99)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (4, "one", "b"), (5, "One two", None),
        (6, prose(80, 1), "b"), (7, prose(80, 1), "b"), (None, prose(60, 2), "c"), (None, None, None), (8, long_text, "c"),
        (9, prose(300, 3), "é"),
    ]
