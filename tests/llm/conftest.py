import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(spark, rows):
    """Documents from (doc_id, text, source) rows, with columns whose names operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), 7, "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOCUMENTS + ", keys int, spans string")


def words_of(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, copies, near copies, one long text and a shared passage."""
    base = words_of(120, 1)
    near = list(base)
    near[60] = "CHANGED"
    far = list(base)
    for k in range(0, 120, 6):
        far[k] = f"other{k}"
    passage = words_of(50, 9)
    return [
        (1, " ".join(base), "a"),
        (2, " ".join(base).upper(), "a"),
        (3, "\n".join(near), "a"),
        (4, " ".join(far), None),
        (5, None, "b"),
        (6, "", "b"),
        (7, " \t\n ", None),
        (8, "one", "b"),
        (9, "one", "c"),
        (10, " ".join(words_of(30, 2) + passage + words_of(30, 3)), "c"),
        (11, " ".join(words_of(20, 4) + passage + words_of(40, 5)), "c"),
        (12, " ".join(["again", "and"] * 60), "a"),
        (13, " ".join(words_of(20000, 6, 100000)), "a"),
        (14, "x" * 30000, "d"),
        (15, "héllo wörld ça va bien 　 日本語", "d"),
        (16, "a b c d", "d"),
        (17, "A B  C\td", "d"),
        (None, "no number here", "d"),
        (18, "repeated row", "e"),
        (18, "repeated row", "e"),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return make_documents(spark, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return make_documents(spark, [])
