import random

import pytest

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=random.Random(-i - 1).randint(2, 8))) for i in range(400)]


@pytest.fixture(scope="session")
def words():
    return WORDS


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, blanks, a long text, repeated rows, and columns with the names that operators use inside."""
    rng = random.Random(3)
    long = text(rng, 30000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, long), (7, long + " more"), (8, "x" * 50000), (9, "é日本😀 \x00 <|endoftext|> </s>"), (9, "é日本😀 \x00 <|endoftext|> </s>"), (None, "nameless text"), (None, None)]
    rows += [(20 + i, text(rng, 40)) for i in range(6)]
    extra = [(*r, "src", 1.0, 2, "x", "y") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, score double, predicted int, row string, component string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
