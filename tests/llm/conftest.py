import random

import pytest

#: Extra columns whose names clash with words that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id long, hash long, block int, label int, tie long, k string, entropy double"


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empties, ties, repeated rows and one long text."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "über", "the") for b in ("ra", "ti", "so", "n", "'s")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [sentence(60) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", *base]
    for _ in range(50):
        parts = [rng.choice(base) if rng.random() < 0.4 else sentence(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        words_of = "\n".join(parts).split(" ")
        if rng.random() < 0.5:
            words_of[rng.randrange(len(words_of))] = rng.choice(words)
        texts.append(" ".join(words_of))
    texts.append(sentence(20_000))
    rows = [(k * 3 % 97, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src22", None]), len(t or ""), 1, 2, 3, 4, 5, 6, "x", 0.5) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    extra = [odd_rows[7], odd_rows[7], (None, "a text without an id that is long enough to be seen by all of them", None, None, None, *odd_rows[0][5:])]
    return spark.createDataFrame(odd_rows + extra, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
