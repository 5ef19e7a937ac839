"""The interval join against a comparison of every pair."""
from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.operators.intervals import interval_join


@pytest.fixture(scope="module")
def many(spark):
    """100,000 overlapping intervals of very uneven length, and points of which a third are equal."""
    rng = np.random.default_rng(11)
    low = rng.integers(0, 1_000_000, 100_000)
    length = rng.integers(1, 40, 100_000)
    length[:30] = 200_000
    length[30:60] = 5_000
    points = rng.integers(-1000, 1_001_000, 3000)
    points[::3] = 500_000
    intervals = spark.createDataFrame([(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(low, length))], "n long, low long, high long")
    return low, low + length, points, intervals, spark.createDataFrame([(i, int(p)) for i, p in enumerate(points)], "id long, at long")


@pytest.mark.parametrize("width", [1, 25, 100_000])
def test_pairs_are_those_of_every_comparison(many, width):
    low, high, points, intervals, table = many
    joined = interval_join(table, intervals, "at", "low", "high", width)
    assert "NestedLoop" not in (plan := joined._jdf.queryExecution().toString()) and "Cartesian" not in plan
    wanted = {(i, int(n)) for i, p in enumerate(points.tolist()) for n in np.flatnonzero((low <= p) & (p < high))}
    made = [(r.id, r.n) for r in joined.select("id", "n").collect()]
    assert len(made) == len(wanted) and set(made) == wanted


@pytest.mark.parametrize("width", [10, 100_000])
def test_left_keeps_points_without_an_interval(many, width):
    low, high, points, intervals, table = many
    few = intervals.filter("n < 50")
    joined = interval_join(table, few, "at", "low", "high", width, "left")
    assert "NestedLoop" not in joined._jdf.queryExecution().toString()
    wanted = sorted((i, int(n)) for i, p in enumerate(points.tolist()) for n in ([x for x in range(50) if low[x] <= p < high[x]] or [-1]))
    assert sorted((r.id, -1 if r.n is None else r.n) for r in joined.collect()) == wanted


def test_bounds_instants_and_nothing(spark):
    start = datetime(2024, 1, 1)
    times = spark.createDataFrame([(i, None if i == 9 else start + timedelta(minutes=i)) for i in range(10)], "id int, at timestamp")
    spans = spark.createDataFrame(
        [("a", start, start + timedelta(minutes=2)), ("b", start + timedelta(minutes=2), start + timedelta(minutes=2, microseconds=1)),
         ("none", start, start), ("back", start, start - timedelta(days=1)), ("open", start, None), ("all", start, start + timedelta(days=900))],
        "name string, low timestamp, high timestamp",
    )
    made = {}
    for r in interval_join(times, spans, "at", "low", "high", 60e6, "left").collect():
        made.setdefault(r.id, set()).add(r.name)
    assert made == {0: {"a", "all"}, 1: {"a", "all"}, 2: {"b", "all"}, **{i: {"all"} for i in range(3, 9)}, 9: {None}}
    assert interval_join(times, spans.limit(0), "at", "low", "high", 60e6).count() == 0
    assert interval_join(times, spans.limit(0), "at", "low", "high", 60e6, "left").count() == 10
    assert interval_join(times.limit(0), spans, "at", "low", "high", 60e6, "left").count() == 0
    days = [df.select(*[F.to_date(c).alias(c) if c in ("at", "low", "high") else c for c in df.columns]) for df in (times, spans)]
    assert {r.name for r in interval_join(*days, "at", "low", "high", 1).collect()} == {"all"}
    with pytest.raises(ValueError):
        interval_join(times, spans, "at", "low", "high", 1, "right")
    with pytest.raises(ValueError):
        interval_join(times, spans.withColumnRenamed("name", "id"), "at", "low", "high", 1)
