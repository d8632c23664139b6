"""Small documents with the awkward cases that every operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n long, size long"


def awkward(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "and", "räven", "über", "naïve", "token", "x", "été", "ding", "12", "ab.", "\U0001f600"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    texts += [None, None, "", "", "   \n\t ", "\n\n", texts[0], texts[0], texts[1], "long " * 40_000, "password: abcdefghij"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None, 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3]]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
