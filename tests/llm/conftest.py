import random

import pytest
from brute import prose


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, and odd texts: (doc_id, text)."""
    r = random.Random(5)
    passages = [prose(r, 80) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "x" * 1500), (3, "x" * 399), (4, "x" * 400), (5, "ab" * 700), (6, "  \t\n "), (7, "one two"), (8, "One  two"), (9, "word " * 60)]
    for i in range(10, 70):
        t = prose(r, r.randrange(3, 200))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(100)
            t += " " + p[a : a + r.choice([100, 390, 400, 401, 520])] + " " + prose(r, r.randrange(40))
        rows.append((i, t))
    for i in range(70, 90):  # near copies
        w = rows[20 + i % 3][1].split(" ")
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[30][1]) for i in range(90, 100)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, block string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
