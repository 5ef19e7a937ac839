"""Generated rows: time slots, named intervals, lists."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.functions.timeframe import TimeRange, as_instant, from_local, local_instant, to_local, truncate
from pagetally.params import ReportParams

# days -> unit of a slot, and the step between slots; 24 stands for hourly slots
UNITS = {24: "hour", 1: "day", 7: "week", 30: "month", 90: "quarter", 365: "year"}
Interval = tuple[str | None, datetime, datetime]
STEPS = {
    "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS",
    "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR",
}


def slots(spark: SparkSession, span: TimeRange, unit: str, tz: str) -> DataFrame:
    """Start instants of all slots that overlap a time range; steps follow the local calendar."""
    last = as_instant(span.hi - timedelta(microseconds=1))
    if unit == "hour":
        # hours are steps of real time from a local hour on, so that a repeated or skipped local hour stays right
        first, end = (truncate(t, "hour", tz) for t in (as_instant(span.lo), last))
        step = F.explode(F.sequence(first, end, F.expr(STEPS[unit])))
        return spark.range(1).select(step.alias("slot"))
    first, end = (F.date_trunc(unit, to_local(t, tz)) for t in (as_instant(span.lo), last))
    local = spark.range(1).select(F.explode(F.sequence(first, end, F.expr(STEPS[unit]))).alias("_slot"))
    return local.select(from_local(F.col("_slot"), tz).alias("slot"))


def named_intervals(text: str, p: ReportParams) -> list[Interval]:
    """``date,name,date,name…`` to (name, start, end): each ends where the next begins, the last at ``as_of``."""
    parts = [part.strip() for part in text.split(",")]
    names = [*parts[1::2], None]  # a last date may come without a name
    starts = sorted(
        ((local_instant(day, p.timezone), name) for day, name in zip(parts[::2], names)), key=lambda s: s[0]
    )
    ends = [start for start, _ in starts[1:]] + [p.as_of]
    return [(name, start, end) for (start, name), end in zip(starts, ends)]


def interval_number(time: Column, intervals: list[Interval]) -> Column:
    """Index of the interval around an instant; intervals are disjoint and few, so no join is needed."""
    number = F.lit(None).cast("int")
    for i, (_, start, end) in enumerate(intervals):
        number = F.when((time >= as_instant(start)) & (time < as_instant(end)), F.lit(i)).otherwise(number)
    return number


def interval_table(spark: SparkSession, intervals: list[Interval]) -> DataFrame:
    """The intervals as rows (n, interval_name, interval_start, interval_end)."""
    rows = [
        F.struct(
            F.lit(i).alias("n"), F.lit(name).alias("interval_name"),
            as_instant(start).alias("interval_start"), as_instant(end).alias("interval_end"),
        )
        for i, (name, start, end) in enumerate(intervals)
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def urls_from_list(lists: DataFrame, column: str) -> DataFrame:
    """One row per entry of a comma list; blanks go, and a trailing comma gives no entry."""
    clean = F.regexp_replace(F.regexp_replace(F.col(column), ",+$", ""), " ", "")
    return lists.withColumn("url", F.explode(F.split(clean, ",")))
