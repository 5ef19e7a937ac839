"""Billable requests per host and month or year."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.functions import filters, metrics
from pagetally.functions import fixed_values as fixed
from pagetally.functions.timeframe import iso_text
from pagetally.operators.ordering import page_after
from pagetally.operators.paging import Pages, write_pages
from pagetally.operators.popularity import top_value_by_count
from pagetally.operators.scan import events
from pagetally.params import ReportParams

SUMS = ["cr_pageviews", "cr_apicalls", "html_requests", "json_requests", "error404_requests"]


def _contains_any(column: Column, parts) -> Column:
    return reduce(or_, (column.contains(part) for part in parts))


def daily_requests(ev: DataFrame, more_sources: tuple[str, ...] = ()) -> DataFrame:
    """Requests per host, day, weight and kind. An id stands for one page request per host and day.

    The fraction of JSON calls is rounded per row of this table, so it cannot be summed earlier.
    """
    source, url = F.col("source"), F.col("url")
    excluded_url = _contains_any(url, fixed.EXCLUDED_URL_PARTS)
    for suffix in fixed.EXCLUDED_URL_SUFFIXES:
        excluded_url = excluded_url | url.endswith(suffix)
    excluded_source = _contains_any(source, fixed.EXCLUDED_SOURCE_PARTS + tuple(more_sources))
    api = (F.col("checkpoint") == "loadresource") & ~source.endswith(".html")
    per_id = ev.groupBy("id", "hostname", F.date_trunc("day", "time").alias("day"), "weight").agg(
        (F.count_if(api) * F.col("weight")).alias("json"),
        (F.count_if(F.col("user_agent").startswith("bot")) > 0).alias("bot"),
        (F.count_if(F.col("checkpoint") == "404") > 0).alias("missing"),
        (F.count_if(excluded_url) > 0).alias("no_page"),
        (F.count_if(excluded_source) > 0).alias("no_api"),
    )
    kinds = ["hostname", "day", "weight", "bot", "missing", "no_page", "no_api"]
    html = F.sum("weight")
    return per_id.groupBy(*kinds).agg(
        html.alias("html_requests"), F.sum("json").alias("json_requests"), F.count("id").alias("n")
    ).select(
        "hostname", "day", "weight", "html_requests", "json_requests", "n",
        F.when(F.col("bot") | F.col("missing") | F.col("no_page"), 0).otherwise(F.col("html_requests"))
        .alias("cr_pageviews"),
        F.when(F.col("bot") | F.col("no_api"), 0).otherwise(metrics.to_int(F.col("json_requests") / 5))
        .alias("cr_apicalls"),
        F.when(F.col("missing"), F.col("html_requests")).otherwise(0).alias("error404_requests"),
    )


def monthly_requests(daily: DataFrame) -> DataFrame:
    """Sums per host and month; the margin of error uses the most frequent sampling rate of its rows."""
    by_rate = daily.groupBy("hostname", F.date_trunc("month", "day").alias("start"), "weight").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS]
    )
    month = by_rate.groupBy("hostname", "start").agg(
        metrics.most_frequent(F.col("weight"), F.col("rows")).alias("rate"),
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS],
    )
    margin = metrics.to_int(metrics.margin_of_error(F.col("rate"), F.col("n")))
    return month.withColumn("cr_margin_of_error", margin).drop("rate", "n")


def request_table(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    granularity: int = 30,
    more_sources: tuple[str, ...] = (),
) -> DataFrame:
    """All months (30) or years (365) per host. Dates are explicit, in UTC. Write it once to page through it."""
    day = p.replace(offset=-1, interval=-1, timezone="UTC", device="all")
    ev = events(raw, day, keys).filter(
        filters.public_hosts(F.col("hostname"), fixed.EXCLUDED_SUFFIXES_CONTENT)
    )
    table = monthly_requests(daily_requests(ev, more_sources))
    letter = "m"
    if granularity == 365:
        letter = "y"
        table = table.groupBy("hostname", F.date_trunc("year", "start").alias("start")).agg(
            F.sum("cr_margin_of_error").alias("cr_margin_of_error"), *[F.sum(c).alias(c) for c in SUMS]
        )
    # a second look at two narrow columns; it shrinks before its shuffle
    hosts = top_value_by_count(ev, ["hostname"], "host", "top_host")
    stamp = F.concat("hostname", F.lit(f"-{letter}-"), F.unix_micros("start").cast("string"))
    month = F.month("start") if letter == "m" else F.lit(None).cast("int")
    return table.join(hosts, "hostname", "left").select(
        F.sha1(stamp).alias("id"), F.year("start").alias("year"), month.alias("month"), "hostname", "top_host",
        (F.col("cr_pageviews") + F.col("cr_apicalls")).alias("content_requests"), "cr_margin_of_error",
        *SUMS, "start",
    )


def request_pages(table: DataFrame, path: str) -> Pages:
    """A ``request_table`` written once to be paged through by position."""
    return write_pages(table, path, "hostname", "start", "id")


def content_requests(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    granularity: int = 30,
    after: str = "-",
    more_sources: tuple[str, ...] = (),
    table: DataFrame | Pages | None = None,
) -> DataFrame:
    """One page in order of host and time, from a written ``request_table``, its ``request_pages``, or a computed one."""
    cursor = None if after == "-" else after
    if isinstance(table, Pages):
        page = table.after(cursor, p.limit)
    else:
        rows = request_table(raw, p, keys, granularity, more_sources) if table is None else table
        page = page_after(rows, ["hostname", "start", "id"], cursor, p.limit, stored=table is not None)
    return page.orderBy("rownum").withColumn("time", iso_text(F.col("start"))).drop("start", "rownum")
