"""Interval join: which intervals a point lies in, by equal bins instead of a comparison of every pair."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level has bins that many times as wide as the one below.
FACTOR = 16


def _number(df: DataFrame, column: str) -> Column:
    """Instants as microseconds, dates as days, numbers as they are."""
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if kind == "date" else F.col(column)


def _bin(value: Column, width: Column) -> Column:
    return F.floor(value / width).cast("bigint")


def interval_join(
    points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, how: str = "inner"
) -> DataFrame:
    """Every pair of a point and an interval with ``start <= at < end``; ``left`` also keeps points that lie in none.

    ``width`` is that of the finest bins, in microseconds for instants and days for dates: best a typical interval's length. Intervals may
    overlap and be of any number. A longer interval takes wider bins, FACTOR times at each level, so that none has more
    than FACTOR + 1 of them; points look into the levels that occur, some few. Spark joins on level and bin, so that
    hot bins are split as those of any other equi-join. Points without a value match nothing; intervals with a missing bound or that
    end before they begin hold nothing. Columns of both sides are kept and must have different names.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    if set(points.columns) & set(intervals.columns):
        raise ValueError("columns of points and intervals must have different names")
    low, high = _number(intervals, start), _number(intervals, end)
    # of numbers, the bin of the end itself may be one too many: the exact bounds decide
    level = F.greatest(F.ceil(F.log2((high - low) / (F.lit(width) * FACTOR)) / math.log2(FACTOR)), F.lit(0)).cast("int")
    leveled = intervals.filter(low < high).withColumn("_level", level)
    size = F.lit(width) * F.pow(F.lit(float(FACTOR)), F.col("_level"))
    binned = leveled.withColumn("_bin", F.explode(F.sequence(_bin(low, size), _bin(high, size))))
    # one row for each level that occurs: a logarithm of the longest interval
    levels = sorted(row[0] for row in leveled.select("_level").distinct().collect())
    if not levels:
        levels = [0]

    def matches(number: int) -> tuple[DataFrame, Column]:
        of_level = binned.filter(F.col("_level") == number).drop("_level")
        here = _bin(_number(points, at), F.lit(width * float(FACTOR) ** number))
        inside = (here == F.col("_bin")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
        return of_level, inside

    if how == "left" and len(levels) == 1:
        of_level, inside = matches(levels[0])
        return points.join(of_level, inside, "left").drop("_bin")
    found = reduce(DataFrame.unionByName, [points.join(*matches(n)).drop("_bin") for n in levels])
    if how == "inner":
        return found
    rest = points
    for n in levels:
        of_level, inside = matches(n)
        rest = rest.join(of_level, inside, "left_anti")
    return found.unionByName(rest, allowMissingColumns=True)
