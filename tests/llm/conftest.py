import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use inside; a table may have them too.
    "size long, node long, key string, range int, fp long, h long, ids string, part int, score double, block int, row int, band int"
)
EXTRA = (5, 5, "x", 5, 5, 5, "x", 5, 0.5, 5, 5, 5)
EN = "the of and to in that with for this be thing enter over land".split()
DE = "der und die nicht auf von sich über wäre schön heiß zeit".split()


def prose(seed: int, n: int, words=EN) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(words) + pick.choice(["", "ing", "er", "st", "en"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in each column, empty and very long texts, copies, near copies, repeated rows, odd white space."""
    long_text = prose(1, 20_000)
    near = prose(2, 300)
    rows = [
        (0, prose(3, 80), "en", "a", 10),
        (1, prose(3, 80), "en", "a", 10),
        (2, None, "en", "b", None),
        (3, "", "en", "b", 0),
        (4, " \t\n ", None, None, 3),
        (5, long_text, "en", "a", len(long_text)),
        (6, near, "en", "c", 1),
        (7, near + " extra", "en", "c", 1),
        (8, prose(4, 60, DE), "de", "c", 1),
        (9, prose(5, 60, DE), "de", "b", 1),
        (9, prose(5, 60, DE), "de", "b", 1),
        (None, prose(6, 30), None, "a", 1),
        (10, "A a", "en", "a", -1),
        (11, "İstanbul ΑΣ 東京 \U0001f600 <|endoftext|> x y é", None, "d", 1),
        (12, "Licensed under the Apache License, Version 2.0. MIT license, mit License", "en", "d", 1),
        (13, "!!! ### 123", "en", "d", 1),
        (14, "w " * 3000, "en", "d", 1),
    ]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
