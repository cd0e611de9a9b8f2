import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
WORDS = "the of and to river stone light carry under over small great wind water north house tree field bread salt".split()


def row(doc_id, text, source="s0"):
    return (doc_id, text, "en", source, None if text is None else len(text), "x")


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(11)

    def make(n):
        return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def awkward(spark, prose):
    """Nulls in any column, empty and very long texts, copies, repeated rows and an extra column."""
    long = prose(30_000)
    a = prose(120)
    rows = [row(i, prose(60 + i)) for i in range(12)]
    rows += [row(20, None), row(21, ""), row(22, "   \n\t "), row(None, a), row(None, None), row(23, a), row(24, a), row(24, a), (25, a, None, None, None, None), row(26, long), row(27, long + " end"), row(28, "é" * 3000), row(29, "\x00\x1f a b")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
