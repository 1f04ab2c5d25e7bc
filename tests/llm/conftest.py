import random

import pytest
from pyspark.sql import types as T

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KIND).repartition(3)


def corpus():
    """Nulls, empty and long texts, exact and near copies, shared passages, repeats inside a text."""
    rng = random.Random(5)
    vocab = ["the", "of", "and", "to", "Été", "straße", "a,", "b.", "x!"] + [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(60)
    base = text(200)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE two"), (5, "one  two")]
    rows += [(10 + k, text(rng.randrange(5, 120))) for k in range(20)]
    rows += [(40 + k, base if k % 2 else base.upper()) for k in range(6)]
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((60 + k, " ".join(words)))
    rows += [(80 + k, text(30) + "\n" + passage + "\n" + text(20)) for k in range(6)]
    rows += [(90, " ".join([text(25)] * 5)), (91, "same " * 400), (92, text(9000))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
