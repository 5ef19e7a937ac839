"""Row numbers, tiles, top-k with remainder, paging and delivery in parts, none of them in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetally.functions import fixed_values as fixed
from pagetally.operators.materialise import materialise

_POSITION_BITS = 33
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def global_row_number(df: DataFrame, *order: Column | str, name: str = "rownum") -> DataFrame:
    """Number all rows from 1 in a total order. ``order`` must identify rows, so that ranges balance.

    Rows are range-partitioned and sorted within partitions; each partition then starts where the
    rows of the partitions before it end. The layout is written first, because sampled range
    bounds may differ between two evaluations.
    """
    session = df.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # partition and position in it are written along: files may be split or joined when they are read
    located = materialise(laid.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_at", _POSITION_BITS)
    )
    # one row of three numbers per partition
    counts = located.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    position = F.col("_at").bitwiseAND(F.lit(_POSITION_MASK))
    return (
        located.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + position + 1)
        .drop("_at", "_part", "_start")
    )


def ntile(df: DataFrame, tiles: int, *order: Column | str, name: str = "tile") -> DataFrame:
    """Split all rows into ``tiles`` equal parts in order; the first parts take the odd rows."""
    numbered = global_row_number(df, *order, name="_row")
    total = numbered.agg(F.count(F.lit(1))).scalar()
    numbered = numbered.withColumn("_total", total)
    size, odd = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
    in_long = F.floor((F.col("_row") - 1) / (size + 1)) + 1
    in_short = F.try_divide(F.col("_row") - 1 - odd * (size + 1), size)
    number = F.when(F.col("_row") <= odd * (size + 1), in_long).otherwise(odd + F.floor(in_short) + 1)
    return numbered.withColumn(name, number.cast("bigint")).drop("_row", "_total")


def top(df: DataFrame, n: int, measure: str, *keys: str) -> DataFrame:
    """The n rows with the largest measure; equals in ascending key order."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def label_top(df: DataFrame, n: int, measure: str, key: str, name: str = "label", rest: str = "Other") -> DataFrame:
    """Add the key as label for the n largest rows, ``rest`` for all others."""
    best = top(df, n, measure, key).select(F.col(key).alias("_best"), F.lit(True).alias("_in"))
    tagged = df.join(best, F.col(key).eqNullSafe(F.col("_best")), "left")
    return tagged.withColumn(name, F.when(F.col("_in"), F.col(key)).otherwise(F.lit(rest))).drop("_best", "_in")


def page_after(
    df: DataFrame,
    order: list[str],
    cursor: str | None,
    limit: int,
    id_column: str = "id",
    name: str = "rownum",
    stored: bool = False,
) -> DataFrame:
    """Rows that follow the cursor row in order, numbered by their position in the whole.

    The cursor is the first row with that id; an unknown one gives no rows. Rows up to it are only
    counted, the page itself is a bounded top-k. Looking up a cursor reads ``df`` three times, so it
    is written first unless it is ``stored`` already, as for a caller that pages through a table.
    """
    if cursor is None:
        page, done = df, F.lit(0)
    else:
        df = df if stored else materialise(df)
        here = F.struct(*order)
        at = df.filter(F.col(id_column) == cursor).orderBy(*order).limit(1).select(here).scalar()
        page = df.filter(here > at)
        done = df.filter(here <= at).agg(F.count(F.lit(1))).scalar()
    page = page.orderBy(*order).limit(limit)
    return page.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + done).cast("bigint"))


def delivery_parts(df: DataFrame, *order: Column | str, max_bytes: int = int(fixed.DELIVERY_BYTES)) -> DataFrame:
    """All rows, numbered by ``part`` from 0 so that a part is some ``max_bytes`` as JSON in the given order.

    A row belongs to the part in which its first byte lies; a part may run over by less than a row.
    ``order`` must identify rows. Sizes are summed within ranges of rows and over one total per range.
    """
    session = df.sparkSession
    ranges = int(session.conf.get("spark.sql.shuffle.partitions"))
    sized = df.withColumn("_size", F.octet_length(F.to_json(F.struct("*"))))
    laid = sized.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    located = materialise(laid.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_range", F.shiftright("_at", _POSITION_BITS)
    )
    totals = located.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = located.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    part = F.floor((F.col("_start") + F.col("_before")) / F.lit(max_bytes)).cast("bigint")
    return before.join(F.broadcast(starts), "_range").select(*df.columns, part.alias("part"))


def running(
    df: DataFrame, keys: list[str], order: list[str], measure: str, before: str = "_before", total: str = "_total"
) -> DataFrame:
    """Add the sum of ``measure`` over the rows of equal ``keys`` before each row in ``order``, and over all of them.

    ``keys`` and ``order`` together must identify rows. Rows are dealt by ranges of both, so that a key may go over any
    number of tasks; they are summed within ranges, and one total per key and range says how much comes before.
    """
    # written, because sampled range bounds may differ between two evaluations
    laid = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = laid.groupBy("_part", *keys).agg(F.sum(measure).alias("_in"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("_part").alias("_of"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_earlier"), F.sum("_in").over(group).alias(total),
    )
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = laid.withColumn("_inside", F.coalesce(F.sum(measure).over(inside), F.lit(0)))
    return summed.join(totals, same).select(*df.columns, (F.col("_earlier") + F.col("_inside")).alias(before), total)
