from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, row string, score string, ids string, size string, part string, _id string, component string"


def table(spark, rows: list[tuple]):
    """Documents (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "xx", s, len(t or ""), *["clash"] * 9) for i, t, s in rows], SCHEMA)


WORDS = "the of and stone river garden walked slowly across morning light over quiet hills while children sang about winter journeys through forests near old bridge market bread fresh water carried home evening stories told again never forgotten".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + (rng.choice(".,") if rng.random() < 0.12 else "") for _ in range(n)]
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and white texts, repeated rows and ids, a very long word, a very long text."""
    long = prose(1, 20_000)
    rows = [(1, prose(2, 50), "a"), (2, None, "a"), (3, "", None), (3, "", None), (None, prose(3, 30), "b"), (None, None, None), (4, " \n\t ", "b"), (5, long, "a"), (6, "x" * 5000, "c"), (7, prose(2, 50), "c"), (7, prose(4, 40), "c"), (8, "Ünïcode 日本 ▁ text\n\n a  b", "d"), (9, "one", ""), (9, "one", "")]
    return table(spark, rows).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
