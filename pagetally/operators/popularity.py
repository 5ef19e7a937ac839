"""Most frequent value and sampled-view estimate per group, in two levels."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.functions.metrics import most_frequent


def top_value_by_count(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group. Values are counted first, so a large group is never gathered."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(most_frequent(F.col(value), F.col("_n")).alias(name))


def top_value_by_sum(df: DataFrame, keys: list[str], value: str, measure: str, name: str) -> DataFrame:
    sums = df.groupBy(*keys, value).agg(F.sum(measure).alias("_n"))
    return sums.groupBy(*keys).agg(most_frequent(F.col(value), F.col("_n")).alias(name))


def estimate_views(cp: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: ``ids`` rows, ``views`` = distinct page views times the largest weight, ``actions``.

    Grouping by id first makes the distinct count a plain count.
    """
    by_id = cp.groupBy(*keys, "id").agg(
        F.count("id").alias("_rows"), F.max("pageviews").alias("_weight"), F.sum("pageviews").alias("_actions")
    )
    return by_id.groupBy(*keys).agg(
        F.sum("_rows").alias("ids"),
        (F.count("id") * F.max("_weight")).alias("views"),
        F.sum("_actions").alias("actions"),
    )
