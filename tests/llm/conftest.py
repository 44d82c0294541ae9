"""Documents with everything that operators must stand: nulls, blanks, ties, repeated rows, long texts, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean, size long, __id string, copies int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "on", "er", "in", "re", "ou", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(2, 60)
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "\t\n", 3), "de", "b"), (4, " ".join(near), "en", None), (5, None, None, None), (6, "", "en", "a"), (7, " \n\t ", "en", "b"),
        (8, prose(3, 40) + " " + shared, "en", "c"), (9, shared + "\n" + prose(4, 50), None, "c"), (10, prose(5, 30_000), "fr", "a"), (11, "word " * 300, "en", "b"), (12, "line one\nline two\nline one\n" * 30, "en", "b"),
        (13, "ünï €uro ☃ \U0001f600 " * 20, "de", "a"), (2, base, "en", "a"), (14, prose(6, 20), "en", "d"), (None, prose(7, 70), "en", "d"), (None, prose(7, 70), "en", "d"), (15, "\x0b".join(prose(8, 60).split()), "es", "a"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), 7, False, 1, "x", 9) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
