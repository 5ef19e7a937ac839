"""Reports over the request log, which is partitioned by month."""
from __future__ import annotations

from datetime import timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.functions import filters
from pagetally.functions import fixed_values as fixed
from pagetally.operators.ordering import top
from pagetally.operators.scan import shards
from pagetally.params import ReportParams


def dev_urls(
    log: DataFrame, p: ReportParams, owner: str, repo: str, branch: str = "main", limit: int = 5
) -> DataFrame:
    """The ``limit`` pages of a branch that were asked for most this month."""
    month = p.as_of.strftime("%Y%m")
    rows = shards(log, month, month).filter(
        (F.col("req_http_x_owner") == owner) & (F.col("req_http_x_repo") == repo) & (F.col("req_http_x_ref") == branch)
        & (F.col("resp_http_content_type") == "text/html; charset=utf-8") & (F.col("status_code") == "200")
        & ~F.col("req_http_x_url").contains(".plain.html") & ~F.col("req_url").contains("/head.html")
    )
    group = ["req_http_x_owner", "req_http_x_repo", "req_http_x_ref", "req_url"]
    table = rows.groupBy(*group).agg(F.count("time_start_usec").alias("requests"))
    return top(table, limit, "requests", "req_url")


def guess_hostname(
    log: DataFrame, p: ReportParams, owner: str = "-", repo: str = "-", ref: str = "-"
) -> DataFrame:
    """Which referring host belongs to which owner, repo and ref, by number of requests."""
    oldest = p.as_of - timedelta(days=p.interval)
    micros = [int(t.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000 + t.microsecond for t in (oldest, p.as_of)]
    time, referer = F.expr("try_cast(time_start_usec AS bigint)"), F.col("req_http_referer")
    host = F.nullif(F.regexp_extract(referer, "https://([^/]+)", 1), F.lit(""))
    wanted = filters.all_of(
        (time > micros[0]) & (time < micros[1]) & referer.rlike("https://[^/]+/.*"),
        filters.without_suffix(host, fixed.EXCLUDED_SUFFIXES_REFERERS),
        filters.equals(F.col("req_http_x_owner"), owner), filters.equals(F.col("req_http_x_repo"), repo),
        filters.equals(F.col("req_http_x_ref"), ref), filters.equals(host, p.url),
    )
    rows = shards(log, oldest.strftime("%Y%m"), p.as_of.strftime("%Y%m")).filter(wanted)
    table = rows.groupBy(
        F.col("req_http_x_owner").alias("owner"), F.col("req_http_x_repo").alias("repo"),
        F.col("req_http_x_ref").alias("ref"), host.alias("host"),
    ).agg(F.count("time_start_usec").alias("requests"))
    return top(table, p.limit, "requests", "owner", "repo", "ref", "host").select(
        "owner", "repo", "ref", "requests", "host"
    )
