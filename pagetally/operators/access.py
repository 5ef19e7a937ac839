"""Access keys: who may read which pages. Keys are stored as SHA-512 hex digests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.functions import filters
from pagetally.functions.timeframe import today
from pagetally.params import ReportParams


def key_digest(secret: str | Column) -> Column:
    return F.sha2(F.lit(secret) if isinstance(secret, str) else secret, 512)


def is_live(p: ReportParams) -> Column:
    return F.col("revoke_date").isNull() | (F.col("revoke_date") > F.lit(today(p)))


def live_keys(keys: DataFrame, secret: str, p: ReportParams) -> DataFrame:
    return keys.filter((F.col("key_bytes") == key_digest(secret)) & is_live(p))


def covers(prefix: Column, wanted: str) -> Column:
    """A key prefix covers the requested url: global, the host itself, a parent domain, or listed."""
    host = wanted.split("/")[0]
    return (
        (prefix == "")
        | (prefix == wanted)
        | F.lit(wanted).startswith(F.concat(prefix, F.lit("/")))
        | F.lit(host).endswith(F.concat(F.lit("."), prefix))
        | prefix.isin(filters.split_list(wanted))
    )


def usable_keys(keys: DataFrame, p: ReportParams) -> DataFrame:
    """Live keys of the request's secret that cover the requested url."""
    live = live_keys(keys, p.domainkey or "", p)
    return live.filter(covers(F.col("hostname_prefix"), p.url))


def url_host(url: Column) -> Column:
    """Host of an https url, null for any other."""
    return F.nullif(F.regexp_extract(url, "^https://([^/]+)/", 1), F.lit(""))


def host_and_parents(host: Column, depth: int) -> Column:
    """The empty text, which a global key has, and the domains of up to `depth` labels that a host is or lies below."""
    # a shorter host is its own domain at every further depth
    return F.array_distinct(F.array(F.lit(""), *[F.substring_index(host, ".", -labels) for labels in range(1, depth + 1)]))


def outermost(prefixes: DataFrame, depth: int) -> DataFrame:
    """The prefixes (a column ``_prefix``) that lie below no other one of up to `depth` labels, each once.

    Their different values are looked at in one row: for few of them, as `usable_keys` lets through.
    """
    every = prefixes.agg(F.collect_set("_prefix").alias("_every"))

    def is_outer(prefix: Column) -> Column:
        return F.size(F.array_intersect(F.array_remove(host_and_parents(prefix, depth), prefix), F.col("_every"))) == 0

    return every.select(F.explode(F.filter("_every", is_outer)).alias("_prefix"))


def restrict_to_key(ev: DataFrame, keys: DataFrame, p: ReportParams) -> DataFrame:
    """Rows whose url lies on a usable key's host or a sub-domain of it; all rows for a global key.

    One plan at any number of sites, and nothing is run to make it: a row's host and the domains above it are looked up
    among the outermost prefixes, of which at most one holds the row, so rows never multiply. Usable prefixes are parts
    of the requested url or listed in it: there are no more of them than the request is long, none has more labels than
    it, and they are broadcast at any size of the key table. What is asked of them is asked of a row's domains as well,
    right after the scan.
    """
    depth = max(wanted.count(".") + 1 for wanted in [p.url, *filters.split_list(p.url)])
    prefixes = outermost(usable_keys(keys, p).select(F.col("hostname_prefix").alias("_prefix")), depth)
    # a column of its own, so that the url is looked at once
    hosts = ev.withColumn("_host", url_host(F.col("url")))
    offered = hosts.select(*ev.columns, F.explode(host_and_parents(F.col("_host"), depth)).alias("_prefix"))
    return offered.join(F.broadcast(prefixes), "_prefix", "left_semi").drop("_prefix")


def privileges(keys: DataFrame, secret: str, p: ReportParams) -> DataFrame:
    """One row: may the secret read everything, may it write everything."""
    everything = F.col("hostname_prefix") == ""
    return live_keys(keys, secret, p).agg(
        F.coalesce(F.bool_or(everything), F.lit(False)).alias("read"),
        F.coalesce(F.bool_or(everything & ~F.col("readonly")), F.lit(False)).alias("write"),
    )


def may_change(keys: DataFrame, secret: str, p: ReportParams, only_global: bool = False) -> bool:
    """Control flow of the table jobs: a live read-write key that is global or is for exactly the url."""
    scope = F.col("hostname_prefix") == ""
    if not only_global:
        scope = scope | (F.col("hostname_prefix") == p.url)
    granted = live_keys(keys, secret, p).filter(scope & ~F.col("readonly"))
    return bool(granted.limit(1).count())
