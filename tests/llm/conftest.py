import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, h long, tag string, words string, fingerprint string, spans int, ids string, id string"


@pytest.fixture
def docs_of(spark):
    """Rows of (doc_id, text) as documents with further columns, some named like columns that operators make."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en" if k % 3 else None, None, len(t) if t else None, k, "x", None, "f", 1, "i", None) for k, (i, t) in enumerate(rows)], CLASHING)

    return make


WORDS = "the a of to and in harbour river stone cloud letter engine window garden paper silver morning quiet under over".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture
def rng():
    import random

    return random.Random(11)


@pytest.fixture
def odd_rows(rng):
    """Nulls, empty and very long texts, repeated rows, null ids."""
    long = prose(rng, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two three"), (5, "one two three"), (None, "one two three four"), (None, None), (6, prose(rng, 60)), (7, "é😀 ß İΣ \x85x　y")]
