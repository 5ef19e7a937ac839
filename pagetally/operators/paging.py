"""Pages of a written table by position: row counts for each range, kept beside the table, say which range a page lies in."""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "_range"


@dataclass(frozen=True)
class Pages:
    """A table in ranges of its order, and an index with a row for each range: its number, rows, and rows before it."""

    rows: DataFrame
    index: DataFrame
    order: tuple[str, ...]
    id_column: str

    def at(self, first: int, limit: int, name: str = "rownum") -> DataFrame:
        """Rows ``first`` (from 1) to ``first + limit - 1`` of the order, numbered. Only the ranges they lie in are read."""
        wanted = (F.col("before") < first - 1 + limit) & (F.col("before") + F.col("n") >= first)
        # no more ranges than rows of the page
        found = self.index.filter(wanted & (F.col("n") > 0)).select(RANGE, "before").collect()
        inside = self.rows.filter(F.col(RANGE).isin([r[0] for r in found]) if found else F.lit(False))
        before = F.lit(0).cast("bigint")
        for number, rows in found:
            before = F.when(F.col(RANGE) == number, F.lit(rows)).otherwise(before)
        place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*self.order)) + before
        numbered = inside.withColumn(name, place.cast("bigint"))
        return numbered.filter(F.col(name).between(first, first + limit - 1)).drop(RANGE)

    def position(self, cursor: str) -> int | None:
        """The number of the first row with that id, None if there is none. Looking for it reads the columns of id and order only."""
        here = self.rows.filter(F.col(self.id_column) == cursor).select(RANGE, *self.order).orderBy(*self.order).first()
        if here is None:
            return None
        of_range = self.rows.filter(F.col(RANGE) == here[RANGE]).select(*self.order)
        upto = F.struct(*self.order) <= F.struct(*[F.lit(here[c]).alias(c) for c in self.order])
        return self.index.filter(F.col(RANGE) == here[RANGE]).first()["before"] + of_range.filter(upto).count()

    def after(self, cursor: str | None, limit: int, name: str = "rownum") -> DataFrame:
        """The page after a row with that id, the first page without one; an unknown id gives no rows."""
        last = 0 if cursor is None else self.position(cursor)
        return self.at(1, 0, name) if last is None else self.at(last + 1, limit, name)


def write_pages(df: DataFrame, path: str, *order: str, id_column: str = "id", ranges: int | None = None) -> Pages:
    """Lay a table out by ranges of ``order``, whose columns must tell rows apart and not be null, and count the ranges."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id())
    laid.write.partitionBy(RANGE).parquet(f"{path}/rows")
    # a table without rows has no file that tells its columns
    spark.createDataFrame([(df.schema.json(),)], "columns string").write.text(f"{path}/columns")
    rows = _rows(spark, path)
    # a row for each range
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")
    return read_pages(spark, path, *order, id_column=id_column)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/columns").first()[0]))
    return spark.read.schema(columns.add(RANGE, "integer")).parquet(f"{path}/rows")


def read_pages(spark: SparkSession, path: str, *order: str, id_column: str = "id") -> Pages:
    return Pages(_rows(spark, path), spark.read.parquet(f"{path}/index"), order, id_column)
