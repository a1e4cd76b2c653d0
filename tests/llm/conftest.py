import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string, h1 long, anchor string, __id long, count int"


def vocabulary(seed=1, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choices("bdfglmnprst", k=1) + rnd.choices("aeiou", k=1) + rnd.choices("bcdfglmnprstaeiou", k=rnd.randrange(1, 7))) for _ in range(n)]


def prose(rnd, n, words=vocabulary()):
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))


def row(i, text):
    return (i, text, "en", "s", None if text is None else len(text), 0.5, "x", 7, "y", 3, 1)


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, repeats, and columns whose names the operators use inside."""
    rnd = random.Random(3)
    base = prose(rnd, 120)
    rows = [row(1, base), row(2, base), row(2, base), row(3, base.replace(base.split()[5], "changed", 1)), row(4, prose(rnd, 90)), row(5, ""), row(6, None), row(None, base), row(7, prose(rnd, 30000)), row(8, "!!! ---"), row(9, "Ünïcode “quotes” 東京 naïve"), (10, "x", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
