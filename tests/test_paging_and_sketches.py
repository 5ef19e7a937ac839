"""Pages by position read one range, and sketches keep their error."""
from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.operators import sketches
from pagetally.operators.paging import read_pages, write_pages


@pytest.fixture(scope="module")
def numbered():
    dice = random.Random(3)
    return sorted((dice.randrange(40), f"id{i:05d}", i * 2) for i in range(5000))


@pytest.fixture(scope="module")
def pages(spark, numbered, tmp_path_factory):
    rows = list(numbered)
    random.Random(4).shuffle(rows)
    path = str(tmp_path_factory.mktemp("pages") / "table")
    write_pages(spark.createDataFrame(rows, "k int, id string, v long"), path, "k", "id", ranges=16)
    return read_pages(spark, path, "k", "id")


def plain(df):
    return [tuple(r) for r in df.orderBy("rownum").collect()]


def ranges_read(df):
    df.collect()
    plans, found = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], []
    while plans:
        leaves = plans.pop().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if "QueryStage" in leaf.nodeName():
                plans.append(leaf.plan())
            elif leaf.metrics().contains("numPartitions"):
                found.append(leaf.metrics().get("numPartitions").get().value())
    return found


def test_pages_by_position(pages, numbered):
    for first, limit in ((1, 10), (311, 1), (600, 700), (4991, 30), (5001, 5), (1, 0)):
        assert plain(pages.at(first, limit)) == [(*row, i + 1) for i, row in enumerate(numbered)][first - 1:first - 1 + limit]


def test_pages_after_a_row(pages, numbered):
    ids = [row[1] for row in numbered]
    for cursor in (ids[0], ids[777], ids[4990]):
        at = ids.index(cursor) + 1
        assert plain(pages.after(cursor, 20)) == [(*row, at + i + 1) for i, row in enumerate(numbered[at:at + 20])]
    assert plain(pages.after(None, 3)) == [(*row, i + 1) for i, row in enumerate(numbered[:3])]
    assert pages.after(ids[-1], 5).count() == 0 and pages.after("nobody", 5).count() == 0


def test_the_last_page_reads_one_range(pages):
    assert ranges_read(pages.at(4996, 5)) == [1] and ranges_read(pages.at(1, 5)) == [1]


def test_an_empty_table_has_no_pages(spark, tmp_path):
    made = write_pages(spark.createDataFrame([], "k int, id string"), str(tmp_path / "empty"), "k", "id")
    assert made.at(1, 10).count() == 0 and made.after("x", 5).count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """200,000 rows of one group with 150,000 different values, and small groups."""
    n = 200_000
    group = F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    return spark.range(0, n + 700, 1, 8).select(group.alias("g"), (F.col("id") * 7919 % 150_000).cast("double").alias("v"), (F.col("id") % 3).alias("day"))


def test_quantiles_within_their_rank_error(hot):
    values = {g: np.sort([r.v for r in hot.filter(F.col("g") == g).select("v").collect()]) for g in ("hot", "g1", "g6")}
    made = sketches.sketches(hot, ["g"], ["v"]).select("g", *[sketches.sketched_quantile("v", s).alias(f"q{s}") for s in (0.05, 0.5, 0.75, 0.99)])
    found = {r.g: r for r in made.collect()}
    assert set(found) == {"hot", *[f"g{i}" for i in range(7)]}
    for g, ordered in values.items():
        for share in (0.05, 0.5, 0.75, 0.99):
            low, high = (np.searchsorted(ordered, found[g][f"q{share}"], side) / len(ordered) for side in ("left", "right"))
            slack = 1.7 / sketches.K + 1 / len(ordered)
            assert low - slack <= share <= high + slack, (g, share)


def test_distinct_counts_within_their_error(hot):
    made = sketches.sketches(hot, ["g"], distinct=["v"]).select("g", sketches.sketched_count("v").alias("n"))
    found = {r.g: r.n for r in made.collect()}
    assert abs(found["hot"] - 150_000) <= 150_000 * 3 * 1.04 / 2 ** (sketches.LG_K / 2)
    assert all(found[f"g{i}"] == 100 for i in range(7))


def test_stored_sketches_merge_to_coarser_keys(hot):
    by_day = sketches.sketches(hot, ["g", "day"], ["v"], ["v"])
    assert by_day.count() == 24
    whole = {r.g: r for r in sketches.merged(by_day, ["g"]).select("g", sketches.sketched_quantile("v", 0.5).alias("q"), sketches.sketched_count("v").alias("n")).collect()}
    assert abs(whole["hot"].q - 75_000) < 1000 and abs(whole["hot"].n - 150_000) < 8000 and whole["g3"].n == 100
