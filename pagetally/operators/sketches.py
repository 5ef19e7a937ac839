"""Approximate quantiles and distinct counts by mergeable sketches, for those who ask for them instead of exact ones.

A sketch of bounded size is made for each key and salt, and those of a key are merged: however hot a key is, no task sees
more than its share of the rows or a sketch for each salt. Sketches are columns of bytes, so that a table of them can be
stored by day and merged over any days later. Quantiles: KLL sketches, whose rank error is some 1.7 / K of the rows or
less for one quantile. Distinct counts: HyperLogLog sketches of 2**LG_K registers, with a relative error of about
1.04 / sqrt(2**LG_K).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, LG_K, SALTS = 2048, 12, 16
QUANTILES, DISTINCT = "quantiles_of_", "distinct_of_"


def sketches(df: DataFrame, keys: list[str], quantiles: list[str] = [], distinct: list[str] = [], salts: int = SALTS) -> DataFrame:
    """Per key a sketch of each named column; nulls count nowhere, and a column without values gives null or an empty sketch."""
    made = [F.kll_sketch_agg_double(F.col(c).cast("double"), K).alias(QUANTILES + c) for c in quantiles]
    made += [F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(DISTINCT + c) for c in distinct]
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)) if salts > 1 else F.lit(0)
    return merged(df.groupBy(*keys, salt.alias("_salt")).agg(*made), keys)


def merged(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys from a table of finer ones."""
    made = [F.kll_merge_agg_double(c, K).alias(c) for c in stored.columns if c.startswith(QUANTILES)]
    made += [F.hll_union_agg(c).alias(c) for c in stored.columns if c.startswith(DISTINCT)]
    return stored.groupBy(*keys).agg(*made)


def sketched_quantile(column: str, share: float):
    return F.kll_sketch_get_quantile_double(QUANTILES + column, F.lit(float(share)))


def sketched_count(column: str):
    return F.hll_sketch_estimate(DISTINCT + column)
