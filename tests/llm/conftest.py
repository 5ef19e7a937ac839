from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from pagetally.session import ship

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # names that the operators use themselves
    T.StructField("key", T.StringType()), T.StructField("part", T.StringType()), T.StructField("rank", T.IntegerType()),
])


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark, Path(__file__).resolve().parents[2])


@pytest.fixture(scope="session")
def make_docs(spark):
    def build(rows: list[tuple[int | None, str | None]], langs: list[str | None] | None = None):
        langs = langs or [None] * len(rows)
        return spark.createDataFrame([(i, t, lang, "x", "y", 1) for (i, t), lang in zip(rows, langs)], SCHEMA)

    return build


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, a repeat within one text, short and empty texts, nulls and repeated rows."""
    rng = random.Random(7)
    passage, line = sentence(rng, 90), sentence(rng, 55)
    rows: list[tuple[int | None, str | None]] = [(i, sentence(rng, rng.randrange(1, 300))) for i in range(40)]
    base = sentence(rng, 200)
    rows += [(100 + i, base) for i in range(5)]
    for i in range(12):
        copy = base.split()
        for _ in range(i % 5):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((120 + i, " ".join(copy)))
    rows += [(140 + i, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 40)) for i in range(8)]
    rows += [(150 + i, sentence(rng, 5) + " " + line + "\t" + line.upper() + " " + line) for i in range(4)]
    rows += [(160, ""), (161, None), (162, " \n\t "), (163, "one"), (164, "one"), (165, "One Two"), (166, "aaaa" * 500), (167, "aaaa" * 300), (168, "a b " * 400)]
    rows += [(None, base), (None, None), (170, "same id, first text " + passage), (170, "same id, other text " + line)]
    rows += [(171, base), (171, base)]
    rows.append((180, sentence(rng, 6000)))
    rng.shuffle(rows)
    return rows
