"""Page views over time, by month and by domain."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetally.functions import filters, metrics
from pagetally.functions import fixed_values as fixed
from pagetally.functions.timeframe import (
    as_instant, instant_text, month_label, time_range, to_local, today, truncate,
)
from pagetally.operators.scan import events, pageviews
from pagetally.operators.slots import UNITS, slots
from pagetally.params import ReportParams


def pageviews_over_time(
    raw: DataFrame, p: ReportParams, keys: DataFrame | None = None, granularity: int = 1
) -> DataFrame:
    """Views and distinct urls per slot, empty slots as zeros, with a forecast of the latest slot.

    ``granularity`` is 24 (hours), 1, 7, 30, 90 or 365 (days); offset and interval count such units.
    """
    unit = UNITS[granularity]
    span = time_range(p, scale=1 if granularity == 24 else granularity)
    ev = events(raw, p, keys, span)
    if p.checkpoint != "-":
        picked = filters.all_of(
            F.col("checkpoint") == p.checkpoint,
            filters.starts_with_any(F.col("source"), p.sources),
            filters.starts_with_any(F.col("target"), p.targets),
        )
        ev = ev.filter(picked)
    views = ev.groupBy("id").agg(
        F.max("weight").alias("pageviews"), F.min("url").alias("url"),
        F.min(truncate(F.col("time"), unit, p.timezone)).alias("slot"),
    )
    by_url = views.groupBy("slot", "url").agg(F.sum("pageviews").alias("pageviews"))
    data = by_url.groupBy("slot").agg(F.count("url").alias("url"), F.sum("pageviews").alias("pageviews"))

    # from here on there is one row per slot
    hours = F.floor((F.unix_seconds(as_instant(p.as_of)) - F.unix_seconds("slot")) / 3600)
    progress = F.greatest(hours / fixed.FORECAST_HOURS, F.lit(1.0))
    previous = Window.orderBy("slot").rowsBetween(-7, -1)
    latest = F.row_number().over(Window.orderBy(F.col("slot").desc())) == 1

    def forecast(name: str, current_share: float):
        value = F.col(name) / progress * current_share + F.avg(name).over(previous) * (1 - current_share)
        return F.when(latest, metrics.to_int(value)).otherwise(F.col(name))

    data = data.withColumn("pageviews_forecast", forecast("pageviews", 0.5)).withColumn(
        "url_forecast", forecast("url", 0.2)
    )
    grid = slots(raw.sparkSession, span, unit, p.timezone)
    filled = grid.join(data, "slot", "full")
    wall = to_local(F.col("slot"), p.timezone)
    counts = ["url", "pageviews", "pageviews_forecast", "url_forecast"]
    return filled.orderBy(F.col("slot").desc()).select(
        F.year(wall).alias("year"), F.month(wall).alias("month"), F.day(wall).alias("day"),
        F.hour(wall).alias("hour"), instant_text(F.col("slot"), p.timezone).alias("time"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


def _months(last: date, days: int, firsts_only: bool) -> list[str]:
    """Labels of the months that the given number of days before ``last`` fall into, in order."""
    labels = []
    for back in range(days, 0, -1):
        day = last - timedelta(days=back)
        label = day.strftime("%Y-%b")
        if (day.day == 1 or not firsts_only) and label not in labels:
            labels.append(label)
    return labels


def pageviews_pivot(
    raw: DataFrame, p: ReportParams, keys: DataFrame | None = None, least: int = 1000
) -> DataFrame:
    """Host by month table of the last year, for hosts with ``least`` views in a recent month."""
    columns = _months(today(p), 365, firsts_only=True)
    recent = _months(today(p), 90, firsts_only=False)
    host = F.col("hostname")
    views = pageviews(events(raw, p, keys)).filter(
        filters.public_hosts(host, fixed.EXCLUDED_SUFFIXES_PIVOT, fixed.READMITTED_HOST)
    )
    month = month_label(F.col("time"))
    grid = (
        views.groupBy(filters.strip_www(host).alias("hostname"), month.alias("month"))
        .agg(F.sum("pageviews").alias("views"))
        .groupBy("hostname").pivot("month", columns).agg(F.sum("views"))
    )
    busy = filters.any_of(*(F.coalesce(F.col(f"`{m}`"), F.lit(0)) >= least for m in recent if m in columns))
    return grid.filter(busy).orderBy("hostname")


def domain_list(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """Domains seen in the last 60 days: first and last visit, views, program and environment ids."""
    host = F.col("hostname")
    views = pageviews(events(raw, p, keys)).filter(
        filters.public_hosts(host, fixed.EXCLUDED_SUFFIXES_DOMAINS, fixed.READMITTED_HOST)
    )
    ids = r"^publish-p([0-9]+)-e([0-9]+)"
    program, environment = (F.nullif(F.regexp_extract("host", ids, i), F.lit("")) for i in (1, 2))
    this_month = month_label(F.col("time")) == p.as_of.strftime("%Y-%b")
    # one row per host name and environment, of which there are few
    parts = views.groupBy(
        filters.strip_www(host).alias("hostname"),
        program.cast("bigint").alias("program_id"), environment.cast("bigint").alias("environment_id"),
    ).agg(
        F.min("time").alias("first"), F.max("time").alias("last"), F.sum("pageviews").alias("views"),
        F.sum(F.when(this_month, F.col("pageviews"))).alias("month_views"),
    )
    whole = Window.partitionBy("hostname")
    day = "yyyy-MM-dd"
    known = F.count("environment_id").over(whole)
    rows = parts.select(
        "hostname", F.lit("").alias("ims_org_id"),
        F.date_format(F.min("first").over(whole), day).alias("first_visit"),
        F.date_format(F.max("last").over(whole), day).alias("last_visit"),
        F.sum("month_views").over(whole).alias("current_month_visits"),
        F.sum("views").over(whole).alias("total_visits"),
        "program_id", "environment_id", known.alias("_known"),
    )
    oldest = (p.as_of.date() - timedelta(days=60)).isoformat()
    rows = rows.filter((F.col("environment_id").isNotNull() | (F.col("_known") == 0)) & (F.col("last_visit") > oldest))
    return rows.drop("_known").orderBy(
        F.col("total_visits").desc(), F.col("current_month_visits").desc_nulls_last(), "hostname",
        "program_id", "environment_id",
    )


def golive_hints(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """Hosts whose first ``top`` event of the range is not older than yesterday."""
    collector = F.col("host").endswith(fixed.GOLIVE_COLLECTOR_SUFFIX) & (F.col("host") != F.col("hostname"))
    ev = events(raw, p, keys).filter(
        (F.col("checkpoint") == "top") & ~collector
        & filters.without_suffix(F.col("hostname"), fixed.EXCLUDED_SUFFIXES_GOLIVE)
    )
    first = ev.groupBy("hostname").agg(F.min("time").alias("first"))
    hosts = first.select("hostname", F.to_date(truncate(F.col("first"), "day", p.timezone)).alias("first_rum"))
    hosts = hosts.filter(F.col("first_rum") >= F.lit(today(p) - timedelta(days=1)))
    return hosts.orderBy("hostname").limit(p.limit)

