import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, block int, body string"
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def frame(spark, texts, schema=SCHEMA):
    """Documents 0, 1, … with the given texts, and columns whose names clash with the operators' own."""
    rows = [(k, t, "en", "s", len(t or ""), "x", 1, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def odd_texts():
    """Null, empty, blank, very long, tied and repeated texts."""
    return [None, "", " \n\t ", "x" * 50_000, "word " * 20_000, "same text here", "same text here", "ÀÉ ñ 日本 😀 a", "\n\n", "end."]


@pytest.fixture
def prose():
    rng = random.Random(5)
    return [" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 120))) for _ in range(60)]


@pytest.fixture
def with_null_id(spark):
    return lambda texts: frame(spark, texts).union(spark.createDataFrame([(None, "null id", None, None, None, None, None, None)], SCHEMA))
