"""Page dashboard: vitals, traffic and shares per page, against the period before."""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetally.functions import filters
from pagetally.functions.fixed_values import VITAL_LIMITS
from pagetally.functions.timeframe import TimeRange, as_instant, time_range
from pagetally.operators.access import url_host
from pagetally.operators.materialise import materialise
from pagetally.operators.ordering import label_top
from pagetally.operators.percentile import quantile_of_each
from pagetally.operators.scan import events
from pagetally.params import ReportParams

VITALS = ("lcp", "fid", "inp", "cls", "ttfb")
MEASURES = [f"{v}good" for v in VITALS] + [f"{v}bad" for v in VITALS] + [f"avg{v}" for v in VITALS]
COLUMNS = (
    ["url", "pageviews", "pageviews_1", "pageviews_diff"] + MEASURES + ["rumshare"]
    + [f"{m}_1" for m in MEASURES] + ["rumshare_1", "url_1"]
)


# The measures are built as SQL text: there are some ninety expressions of four kinds.


def _whole(measure: str, value: str) -> str:
    """Measures are whole numbers, layout shift has three digits."""
    return f"round({value}, 3)" if measure == "avgcls" else f"CAST(round({value}) AS bigint)"


def _share(vital: str, test: str, alias: str) -> Column:
    """Whole percentage of the measured page views that pass a test."""
    flag = f"{vital} {test}"
    return F.expr(f"CAST(round(try_divide(count_if({flag}), count({flag})) * 100) AS bigint) AS {alias}")


def _mean(measure: str, weight: str) -> str:
    """Mean over all weights; a null measure counts in the denominator only."""
    return f"try_divide(sum({measure} * {weight}), sum({weight}))"


def _per_view(ev: DataFrame, span: TimeRange, p: ReportParams, owner: str, repo: str) -> DataFrame:
    """One row per period and page view. Both periods come from the same scan."""
    everything = p.url == owner == repo == "-"
    if p.url == "-" and not everything:
        wanted = filters.branch_preview(F.col("url"), owner, repo)
    else:
        wanted = F.lit(True)
    rows = ev.select(
        "id", "weight", (F.col("time") >= as_instant(span.lo)).alias("current"), wanted.alias("wanted"),
        F.when(wanted, F.col("url")).alias("url"),
        *[F.when(wanted, F.col(v)).alias(v) for v in VITALS],
    )
    views = rows.groupBy("id", "current").agg(
        F.max("weight").alias("weight"), F.bool_or("wanted").alias("wanted"), F.max("url").alias("url"),
        *[F.max(v).alias(v) for v in VITALS],
    )
    return views.withColumn("url", url_host(F.col("url"))) if everything else views


def _per_url(views: DataFrame) -> DataFrame:
    """Measures per period and url: within one sampling weight first, then weighted over weights."""
    group = ["current", "wanted", "url", "weight"]
    shares = views.groupBy(*group).agg(
        F.count("id").alias("events"),
        *[_share(v, f"<= {VITAL_LIMITS[v][0]}", f"{v}good") for v in VITALS],
        *[_share(v, f">= {VITAL_LIMITS[v][1]}", f"{v}bad") for v in VITALS],
    )
    p75 = quantile_of_each(views, group, list(VITALS), 0.75)
    p75 = p75.select(
        *[F.col(k).alias(f"_{k}") for k in group], *[F.expr(f"{_whole(f'avg{v}', v)} AS avg{v}") for v in VITALS]
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in group])
    by_weight = shares.join(p75, same, "left")
    by_url = by_weight.groupBy("current", "wanted", "url").agg(
        F.expr("sum(events * weight) AS pageviews"),
        *[F.expr(f"{_mean(m, 'weight')} AS {m}") for m in MEASURES],
    )
    return by_url.withColumn("avgcls", F.round("avgcls", 3))


def dashboard(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    owner: str = "-",
    repo: str = "-",
    rising: bool = False,
) -> DataFrame:
    """``limit`` pages with most views, the others as "Other"; with ``rising`` every page, by growth."""
    span = time_range(p)
    both = TimeRange(span.before().lo, span.hi)
    urls = materialise(_per_url(materialise(_per_view(events(raw, p, keys, both), span, p, owner, repo))))
    # at most two rows
    totals = urls.groupBy("current").agg(F.sum("pageviews").alias("total"))
    shown = urls.filter("wanted")
    if rising:
        labelled = shown.withColumn("label", F.col("url"))
    else:
        periods = [shown.filter("current"), shown.filter("NOT current")]
        labelled = label_top(periods[0], p.limit, "pageviews", "url").unionByName(
            label_top(periods[1], p.limit, "pageviews", "url")
        )
    labelled = labelled.join(F.broadcast(totals), "current")

    def of_period(suffix: str) -> list[Column]:
        inside = "NOT current" if suffix else "current"
        views, total = (f"CASE WHEN {inside} THEN {c} END" for c in ("pageviews", "total"))
        made = [F.expr(f"sum({views}) AS pageviews{suffix}")]
        made += [F.expr(f"{_whole(m, _mean(m, views))} AS {m}{suffix}") for m in MEASURES]
        return made + [F.expr(f"try_divide(100 * sum({views}), max({total})) AS rumshare{suffix}")]

    joined = labelled.groupBy("label").agg(*of_period(""), *of_period("_1"))
    growth = F.coalesce("pageviews", F.lit(0)) - F.coalesce("pageviews_1", F.lit(0))
    joined = joined.withColumn("pageviews_diff", growth).withColumn("url", F.col("label"))
    joined = joined.withColumn("url_1", F.when(F.col("pageviews_1").isNotNull(), F.col("label")))
    lead = [F.col("pageviews_diff").desc()] if rising else []
    order = lead + [
        F.col("pageviews").desc_nulls_last(), F.col("pageviews_1").desc_nulls_last(), F.col("url").asc_nulls_last(),
    ]
    if not rising:
        # at most two tops and "Other" are left here
        rank = F.row_number().over(Window.orderBy(*order))
        joined = joined.withColumn("_rank", rank).filter((F.col("_rank") <= p.limit) | (F.col("url") == "Other"))
    last = F.when(F.col("url") == "Other", 1).otherwise(0)
    return joined.orderBy(last, *order).select(*COLUMNS)
