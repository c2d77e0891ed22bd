import random

import pytest

SCHEMA = "doc_id bigint, text string, id string, fp int, v int, key string, size int, gram string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, ties and repeated rows, and columns whose names clash."""
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma", "DELTA", "é", "Ünï", "x1", "y-2", "the", "of", "and"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other = say(70), say(64)
    texts = [None, "", "  \n\t ", "one", "one two", say(30), say(5000), " a b", "a" * 30_000]
    texts += [f"{say(12)} {passage} {say(9)}", f"{say(4)}\n{passage}\t{say(3)}", passage, passage, f"{passage} {passage}", f"{other} {passage[:120]}", f"{say(3)} {other}", other + " " + say(20)]
    near = say(200).split(" ")
    for k in range(6):
        copy = list(near)
        copy[20 * k] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[9], texts[9], "word " * 120]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[10], (None, texts[9]), (None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1, 2, "k", 3, "g") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)
