import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k string, rank int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def docs(spark):
    """Make documents from ``(doc_id, text, source)``; extra columns have names that operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash", 7) for i, t, s in rows], DOCS)

    return make


@pytest.fixture
def odd_rows(rng):
    """Nulls in every column, empty and blank texts, repeated rows, shared ids, one long text."""
    long = "\n".join(words(rng, 60) for _ in range(80))
    return [(None, None, None), (1, "", "a"), (2, " \n\t ", None), (3, "one word", "a"), (3, "one word", "a"), (3, "another text here", "b"), (None, "no id", "b"), (4, long, "a"), (5, long, "b"), (6, "é日本 " * 40, "c")]
