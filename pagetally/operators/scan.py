"""Filtered event scan and its two roll-ups."""
from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from pagetally.functions import filters
from pagetally.functions.timeframe import TimeRange, time_range
from pagetally.operators.access import restrict_to_key
from pagetally.params import ReportParams

EVENT_COLUMNS = [
    "hostname", "host", "user_agent", "time", "url", "lcp", "fid", "inp", "cls", "ttfb",
    "referer", "id", "source", "target", "weight", "checkpoint",
]


def in_range(raw: DataFrame, span: TimeRange) -> DataFrame:
    """Rows of a time range; a table partitioned by ``event_date`` is pruned as well."""
    rows = raw.filter(span.contains(F.col("time")))
    if "event_date" in raw.columns:
        rows = rows.filter(F.col("event_date").between(span.lo.date(), span.hi.date()))
    return rows


def on_days(raw: DataFrame, days: DataFrame, column: str) -> DataFrame:
    """Rows of a table partitioned by ``event_date`` on days that are rows of another table.

    A semi-join on the partition column: Spark reads only the partitions of those days, which it learns as the query runs.
    """
    wanted = days.filter(F.col(column).between("0001-01-01", "9999-12-31")).select(F.col(column).cast("date").alias("_day"))
    return raw.join(wanted, F.col("event_date") == F.col("_day"), "left_semi")


def _filtered(raw: DataFrame, p: ReportParams, span: TimeRange, *more) -> DataFrame:
    rows = in_range(raw, span)
    predicate = filters.all_of(
        filters.page_matches(F.col("url"), F.col("hostname"), p.url),
        filters.device_class(F.col("user_agent"), p.device),
        *more,
    )
    return rows if predicate is None else rows.filter(predicate)


def _readable(rows: DataFrame, p: ReportParams, keys: DataFrame | None) -> DataFrame:
    """What ``p.domainkey`` opens. To read without keys is the choice of a caller that names no secret."""
    if keys is not None:
        return restrict_to_key(rows, keys, p)
    if p.domainkey:
        raise ValueError("a domainkey needs the table of keys")
    return rows


def events(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    span: TimeRange | None = None,
) -> DataFrame:
    """Events a report works on: in range, of the wanted pages and devices, valid, and readable
    with ``p.domainkey`` when a key table is given."""
    rows = _filtered(
        raw, p, span or time_range(p),
        filters.valid_weight(F.col("weight")),
        filters.valid_hostname(F.col("hostname")),
    )
    return _readable(rows, p, keys).select(*EVENT_COLUMNS)


def events_v3(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """Older scan: closed upper bound, no quality filters, no TTFB."""
    rows = _filtered(raw, p, time_range(p, closed=True))
    return _readable(rows, p, keys).select(*[c for c in EVENT_COLUMNS if c != "ttfb"])


def cluster_events(raw: DataFrame, p: ReportParams, generation: str = "-") -> DataFrame:
    """Oldest scan: as ``events_v3`` without keys, with a filter on the code generation."""
    return _filtered(
        raw, p, time_range(p, closed=True), filters.equals(F.col("generation"), generation)
    )


def by_text_keys(df: DataFrame, *keys: str) -> GroupedData:
    """Group by several text columns, led by their hash; drop ``_hash`` from the result.

    An aggregate that carries text sorts its input. With the hash in front, nearly all comparisons
    are between two numbers.
    """
    return df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)


def pageviews(ev: DataFrame) -> DataFrame:
    """One row per sampled page view. ``pageviews`` is the number of views it stands for."""
    vitals = [c for c in ("lcp", "cls", "fid", "inp", "ttfb") if c in ev.columns]
    texts = [c for c in ("hostname", "host", "url", "referer", "user_agent", "generation") if c in ev.columns]
    return ev.groupBy("id").agg(
        F.max("time").alias("time"),
        F.max("weight").alias("pageviews"),
        *[F.max(c).alias(c) for c in vitals],
        *[F.min(c).alias(c) for c in texts],
    )


def checkpoints(ev: DataFrame) -> DataFrame:
    """One row per page view, checkpoint, target and source."""
    texts = [c for c in ("hostname", "host", "url", "referer", "user_agent", "generation") if c in ev.columns]
    return by_text_keys(ev, "id", "checkpoint", "target", "source").agg(
        F.max("time").alias("time"),
        F.max("weight").alias("pageviews"),
        *[F.min(c).alias(c) for c in texts],
    ).drop("_hash")


def shards(log: DataFrame, first_month: str, last_month: str) -> DataFrame:
    """Request log of a range of ``YYYYMM`` labels; prunes a table partitioned by ``month``."""
    return log.filter(F.col("month").between(first_month, last_month))
