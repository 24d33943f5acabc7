"""Shared fixtures (imported by name: a second conftest would hide the one above)."""

import random

import pytest

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "k1 string, t string, bucket string, norm string, block string"


def rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, several sources."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.randint(20, 120)) for _ in range(25)]
    out = []
    for i in range(90):
        t = base[rng.randrange(25)] if i % 3 else text(rng.randint(1, 150))
        if i % 5 == 0:
            t = t + " " + text(3)
        if i % 7 == 0:
            t = t.upper()
        out.append((i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 11 else None, len(t)))
    out += [(90, None, None, None, None), (91, "", "en", "s0", 0), (92, "", "en", "s0", 0),
            (93, "  \n\t ", "en", "s1", 5), (94, "ä" * 300 + " é", "de", "s1", 302),
            (95, " ".join([base[0]] * 60), "en", "s2", 9), (96, "one", "en", "s2", 3), (97, "One", "en", "s3", 3),
            (98, base[1], "en", "s0", 1), (98, base[1], "en", "s0", 1), (None, base[2], "en", "s0", 1),
            (None, "only here with a null id", "en", "s0", 1)]
    return out


@pytest.fixture(scope="session")
def sample(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, sample):
    """The sample with further columns named like working columns of the operators."""
    from pyspark.sql import functions as F
    return sample.select("*", *[F.lit("x").alias(c.split()[0]) for c in CLASHING.split(", ")])
