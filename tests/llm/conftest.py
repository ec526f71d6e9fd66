import random

import pytest

EXTRA = "size int, n int, key string, row string, spans string, hits int, label int, fp long, score double, chunk int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def make(rows, parts=3):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        padded = [(d, t, lang, s, None if t is None else len(t), *[None] * 10) for d, t, lang, s in full]
        return spark.createDataFrame(padded, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented sentences, the same for a seed."""

    def make(seed, words=60):
        draw = random.Random(seed)
        parts = ["the", "and", "of", "er", "tion", "lo", "ma", "Ré", "zu", "an", "st"]
        return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(words))

    return make


ODD = [(900, None), (901, ""), (902, "  \n\t "), (None, "An id is missing here"), (903, "...!!"), (904, "é" * 300)]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
