"""Popularity of sources, targets and pages."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.functions import filters, metrics
from pagetally.operators.materialise import materialise
from pagetally.operators.ordering import running, top
from pagetally.operators.popularity import estimate_views
from pagetally.operators.scan import checkpoints, events
from pagetally.params import ReportParams


def _picked(raw: DataFrame, p: ReportParams, keys: DataFrame | None, *more) -> DataFrame:
    """Events of the wanted checkpoint and source, filtered before any grouping."""
    rows = events(raw, p, keys)
    predicate = filters.all_of(
        filters.equals(F.col("checkpoint"), p.checkpoint), filters.equals(F.col("source"), p.source), *more
    )
    return rows if predicate is None else rows.filter(predicate)


def sources(
    raw: DataFrame, p: ReportParams, keys: DataFrame | None = None, aggregate: bool = True
) -> DataFrame:
    """Popularity per source and checkpoint; per url too unless ``aggregate``."""
    cp = checkpoints(_picked(raw, p, keys, F.col("source").isNotNull()))
    views = cp.groupBy("source", "id", "checkpoint").agg(
        F.max("url").alias("url"), F.max("pageviews").alias("views"), F.sum("pageviews").alias("actions")
    )
    by_url = views.groupBy("source", "checkpoint", "url").agg(
        F.count("id").alias("ids"), F.sum("views").alias("views"), F.sum("actions").alias("actions")
    )
    if aggregate:
        table = by_url.groupBy("source", "checkpoint").agg(
            F.sum("ids").alias("ids"), F.count("url").alias("pages"), F.lit("").alias("url"),
            metrics.most_frequent(F.col("url"), F.col("ids")).alias("topurl"),
            F.sum("views").alias("views"), F.sum("actions").alias("actions"),
        )
    else:
        table = by_url.withColumn("pages", F.when(F.col("url").isNull(), 0).otherwise(1).cast("bigint"))
        table = table.withColumn("topurl", F.lit(""))
    table = table.withColumn("actions_per_view", F.try_divide("actions", "views"))
    return top(table, p.limit, "views", "checkpoint", "source", "url").select(
        "checkpoint", "source", "ids", "pages", "url", "topurl", "views", "actions", "actions_per_view"
    )


def sources_targets(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """Popularity per source, checkpoint and target, with the agents that follow them."""
    cp = checkpoints(_picked(raw, p, keys, F.col("source").isNotNull()))
    group = ["source", "checkpoint", "target"]
    pairs = cp.groupBy(*group, "url", "user_agent").agg(
        F.count("id").alias("n"), F.sum("pageviews").alias("views")
    )
    # the two margins of the pairs in one pass: per url and per agent
    url_set, agent_set = [F.col(c) for c in group + ["url"]], [F.col(c) for c in group + ["user_agent"]]
    margins = pairs.groupingSets(
        [url_set, agent_set], *group, "url", "user_agent"
    ).agg(F.sum("n").alias("n"), F.sum("views").alias("views"), F.grouping("url").alias("_agents"))
    per_url, per_agent = F.col("_agents") == 0, F.col("_agents") == 1
    url, agent = F.when(per_url, F.col("url")), F.when(per_agent, F.col("user_agent"))
    table = margins.groupBy(*group).agg(
        F.sum(F.when(per_url, F.col("n"))).alias("ids"), F.count(url).alias("pages"),
        metrics.most_frequent(url, F.col("n")).alias("topurl"), F.count(agent).alias("user_agents"),
        metrics.most_frequent(agent, F.col("n")).alias("top_user_agent"),
        F.sum(F.when(per_url, F.col("views"))).alias("views"),
    )
    table = table.withColumn("actions", F.col("views"))
    return top(table, p.limit, "views", "checkpoint", "source", "target").select(
        "checkpoint", "source", "target", "ids", "pages", "topurl", "user_agents", "top_user_agent",
        "views", "actions",
    )


def targets(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    separator: str = ";",
    extract: str = "-",
) -> DataFrame:
    """Popularity of target parts: split at ``separator`` and a blank, or all matches of ``extract``."""
    cp = checkpoints(_picked(raw, p, keys, F.col("target").isNotNull()))
    views = cp.groupBy("target", "id", "checkpoint").agg(
        filters.strip_query(F.max("url")).alias("url"), F.max("pageviews").alias("views")
    )
    if extract == "-":
        parts = F.split("target", r"\Q" + separator + r" \E")
    else:
        parts = F.regexp_extract_all("target", F.lit(extract), F.lit(min(re.compile(extract).groups, 1)))
    rows = views.select("id", "checkpoint", "url", "views", F.explode(parts).alias("target"))
    by_url = rows.groupBy("target", "checkpoint", "url").agg(
        F.count("id").alias("ids"), F.sum("views").alias("views")
    )
    table = by_url.groupBy("target", "checkpoint").agg(
        F.sum("ids").alias("ids"), F.count("url").alias("pages"),
        metrics.most_frequent(F.col("url"), F.col("ids")).alias("topurl"), F.sum("views").alias("views"),
    )
    return top(table, p.limit, "views", "checkpoint", "target").select(
        "checkpoint", "target", "ids", "pages", "topurl", "views"
    )


# Sources listed in one row of the report on missing pages; a longer list goes on in rows of its own.
LISTED_SOURCES = 100_000


def not_found(
    raw: DataFrame, p: ReportParams, keys: DataFrame | None = None, listed_sources: int = LISTED_SOURCES
) -> DataFrame:
    """Pages with ``404`` events, their views and the sources that lead to them.

    Sources are in order. A row lists at most ``listed_sources`` of them: the first are in ``part`` 0, the next
    as many in part 1, so that no row grows with a busy page.
    """
    cp = checkpoints(events(raw, p, keys).filter(F.col("checkpoint") == "404"))
    by_source = materialise(estimate_views(cp, ["url", "source"]))
    table = by_source.groupBy("url").agg(
        metrics.most_frequent(F.col("source"), F.col("views")).alias("top_source"),
        F.count("source").alias("source_count"), F.sum("views").alias("views"),
    )
    # lists are built for the reported pages only
    best = materialise(top(table, p.limit, "views", "url"))
    shown = by_source.filter(F.col("source").isNotNull()).select("url", "source", F.lit(1).alias("one")).join(best.select("url"), "url")
    part = F.floor(F.col("_before") / listed_sources).cast("bigint")
    placed = running(shown, ["url"], ["source"], "one").withColumn("part", part)
    lists = placed.groupBy("url", "part").agg(F.sort_array(F.collect_list("source")).alias("all_sources"))
    # a page whose events name no source has an empty list
    return best.filter(F.col("url").isNotNull()).join(lists, "url", "left").select(
        "url", "top_source", F.coalesce("all_sources", F.array().cast("array<string>")).alias("all_sources"),
        "source_count", "views", F.coalesce("part", F.lit(0)).alias("part"),
    ).orderBy(F.col("views").desc(), "url", "part")


def checkpoint_urls(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """Views and actions per url, checkpoint and source."""
    table = estimate_views(checkpoints(_picked(raw, p, keys)), ["url", "checkpoint", "source"])
    table = table.withColumn("actions_per_view", F.try_divide("actions", "views"))
    return top(table, p.limit, "views", "url", "checkpoint", "source").select(
        "ids", "views", "actions", "url", "checkpoint", "source", "actions_per_view"
    )
