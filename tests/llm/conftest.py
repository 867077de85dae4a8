import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, bucket int, n int, score double, d long"
WORDS = [a + b + c for a in ("ba", "ke", "li", "no", "ru", "so") for b in ("da", "fe", "gi", "ho") for c in ("m", "n", "st", "r", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) as documents with nulls elsewhere and columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, 1, "x", 2, 3, 0.5, 4) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, ties, repeats, copies, near-copies, a very long text."""
    rng = random.Random(4)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = "\n".join(prose(rng, 40) for _ in range(2000))
    shared = prose(rng, 60)
    return [
        (None, "a null key " + prose(rng, 30)), (1, None), (2, ""), (3, " \t\n "), (4, base), (5, base), (6, " ".join(near)), (6, " ".join(near)), (7, "one"), (8, "one"),
        (9, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 30)), (10, shared + "\n" + prose(rng, 50)), (11, long), (12, "aaaa" * 200), (13, "é" * 130 + "ü" * 130), (14, prose(rng, 3)),
    ]
