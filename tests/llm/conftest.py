from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, copies, near copies, repeated rows, one very long text, ids out of order."""
    rng = random.Random(7)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(9, base, "xx", "a"), (4, base, "xx", None), (7, " ".join(near), None, "b"), (1, "", "xx", "a"), (2, None, "yy", "a"), (3, " \t\n ", "yy", "b")]
    rows += [(5, "One", "xx", "b"), (6, "one", "xx", "c"), (8, "one two", "yy", "c"), (10, sentence(rng, 20_000), "yy", "c"), (11, "!!! 123", "xx", "")]
    rows += [(100 + i, sentence(rng, rng.randint(1, 80)), "xx" if i % 2 else "yy", "abc"[i % 3]) for i in range(25)]
    rows += [(200, sentence(rng, 30) + " " + base[:400], "xx", "a"), (12, base.upper(), "xx", "b")]
    rows += [rows[0], rows[11]]
    return [(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clash(odd):
    """The same rows with extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    extra = "size target taken whole p rank cell room key h n s1 s2 head token host words lines score x held_out kept spans hash html template salt label near".split()
    return odd.select("*", *[F.lit("other").alias(c) for c in extra])
