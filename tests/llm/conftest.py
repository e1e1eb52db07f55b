from __future__ import annotations

import random

import pytest

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two may first then do".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(["ing", "ed", "ly", ""]) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like results."""
    rows = [
        (0, prose(60, 1)), (1, None), (2, ""), (3, " \t\n "), (None, prose(40, 2)), (None, None), (4, prose(60, 1)), (4, prose(60, 1)), (5, prose(30, 3)), (5, prose(30, 4)),
        (6, "one"), (7, "é ü 漢字 🎉 " * 3), (8, prose(30_000, 5)), (9, "x" * 50_000),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: "x" for c in ("score", "kept", "ids", "leaks", "licenses", "n_replaced", "evidence", "selected", "log_weight", "probability", "key", "id", "component", "round_trip")}
    from pyspark.sql import functions as F

    return frame.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, 1), (4, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
