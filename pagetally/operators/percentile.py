"""Exact quantiles by radix selection: a group is never held in one task.

The digit of a value is its sign, its power of two and the next 16 bits, as a number that rises with the value. Copies of
a value are counted, the counts are added up by group and digit, and running counts tell which digit holds the wanted
rank. Only values with that digit go on, and running counts over them find the value. A task orders the digits of a group
(at most DIGITS for each power of two that its values span) or its different values within one digit, never all of them.
There is no range shuffle, no sample and no table in between.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits for one power of two. Values below two to LEAST_POWER share a digit; infinity and, after it, NaN are BEYOND all others.
DIGITS, LEAST_POWER, BEYOND = 1 << 16, -1000, 1 << 40


def radix_digit(value: Column) -> Column:
    """A whole number that never falls where the value rises."""
    x = value.cast("double")
    size = F.abs(x)
    # log2 may be off next to a power of two, but never falls where the value rises, and so the digit doesn't
    power = F.greatest(F.floor(F.log2(size)), F.lit(LEAST_POWER)).cast("int")
    bits = F.floor(size * F.pow(F.lit(2.0), -power) * DIGITS)
    digit = (power - LEAST_POWER + 1).cast("bigint") * (4 * DIGITS) + bits
    sign = F.when(x < 0, -1).otherwise(1)
    zero = F.lit(0).cast("bigint")
    found = (
        F.when(x == 0, zero).when(F.isnan(x), F.lit(BEYOND + 1)).when(size == float("inf"), sign * F.lit(BEYOND)).otherwise(sign * digit)
    )
    # never null, else joins filter by it in one branch of a plan but not in the other, and the branches share nothing
    return F.coalesce(found, zero)


def _picked(counts: DataFrame, within: list[str], digit: str, ranks: list[str]) -> DataFrame:
    """The digits that hold a wanted rank, with the ranks counted from the digit's first row, null for others."""
    upto = F.sum("_n").over(Window.partitionBy(*within).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("_upto") - F.col("_n")
    inside = [F.when((F.col(r) > before) & (F.col(r) <= F.col("_upto")), F.col(r) - before).alias(r) for r in ranks]
    others = [c for c in counts.columns if c not in (*ranks, "_n")]
    return counts.withColumn("_upto", upto).select(*others, *inside).filter(F.coalesce(*ranks).isNotNull())


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key and named share the smallest value whose cumulative share reaches it.

    Nulls are left out, NaN is the greatest value, keys may be null. A key without values gives no row.
    """
    ranks = [f"_r{i}" for i in range(len(shares))]
    # as one struct, in which nulls are equal
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    values = (
        df.filter(F.col(value).isNotNull()).select(key.alias("_k"), F.col(value).alias("_v"))
        .groupBy("_k", radix_digit(F.col("_v")).alias("_digit"), "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = values.groupBy("_k", "_digit").agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("_k"))
    wanted = [F.greatest(F.ceil(total * share), F.lit(1)).cast("bigint").alias(r) for r, share in zip(ranks, shares.values())]
    buckets = _picked(counts.select("*", *wanted), ["_k"], "_digit", ranks)
    last = values.join(buckets, ["_k", "_digit"])
    found = _picked(last, ["_k", "_digit"], "_v", ranks).groupBy("_k").agg(*[
        F.max(F.when(F.col(r).isNotNull(), F.col("_v"))).alias(n) for n, r in zip(shares, ranks)
    ])
    return found.select(*[F.col("_k").getField(k).alias(k) for k in keys], *shares)


def exact_quantile(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: share})


def quantile_of_each(df: DataFrame, keys: list[str], columns: list[str], share: float) -> DataFrame:
    """Per key the exact quantile of each of several columns, under their names. Keys without any reading give no row."""
    readings = F.explode(F.array(*[
        F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in columns
    ]))
    long = df.select(*keys, readings.alias("_r")).select(*keys, "_r.*")
    found = exact_quantile(long, [*keys, "_name"], "_value", share, "_q")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(c) for c in columns])
