"""Experiments, named intervals, and how speed goes with clicks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetally.functions import filters, metrics
from pagetally.functions.timeframe import TimeRange, instant_text
from pagetally.operators.materialise import materialise
from pagetally.operators.ordering import ntile
from pagetally.operators.scan import checkpoints, events
from pagetally.operators.slots import interval_number, interval_table, named_intervals
from pagetally.params import ReportParams


def _converting(p: ReportParams, conversion: str):
    return filters.all_of(
        F.col("checkpoint") == conversion,
        filters.starts_with_any(F.col("source"), p.sources),
        filters.starts_with_any(F.col("target"), p.targets),
    )


def experiments(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    experiment: str = "-",
    conversioncheckpoint: str = "click",
    threshold: int = 500,
) -> DataFrame:
    """Conversion of each experiment variant against its control, with p value and days still to run.

    An id converts for one variant only, the first by name.
    """
    trial = filters.all_of(F.col("checkpoint") == "experiment", filters.equals(F.col("source"), experiment))
    converts = _converting(p, conversioncheckpoint)
    cp = checkpoints(events(raw, p, keys).filter(trial | converts))
    # per id: its variants, and one row with its conversion (both in one row if they coincide)
    marks = cp.groupBy(
        "id", F.coalesce(trial, F.lit(False)).alias("trial"),
        F.when(trial, F.col("source")).alias("experiment"), F.when(trial, F.col("target")).alias("variant"),
    ).agg(
        F.max("pageviews").alias("pageviews"), F.max("time").alias("time"), F.min("url").alias("url"),
        F.max(F.when(converts, F.col("pageviews"))).alias("converted"),
    )
    same = Window.partitionBy("id")
    name = F.struct("experiment", "variant")
    marks = marks.withColumn("converted", F.max("converted").over(same)).withColumn(
        "first", F.min(F.when(F.col("trial"), name)).over(same)
    )
    hit = F.when(name.eqNullSafe(F.col("first")), F.col("converted"))
    rates = marks.filter("trial").groupBy("experiment", "variant").agg(
        F.count("id").alias("events"), F.sum("pageviews").alias("views"),
        F.nullif(F.count(hit), F.lit(0)).alias("hit_events"), F.sum(hit).alias("hits"),
        F.min("url").alias("topurl"), F.max("time").alias("t95"), F.min("time").alias("t5"),
    )
    rates = rates.withColumn("rate", F.try_divide("hits", "views")).withColumn(
        "tdiff", F.floor((F.unix_micros("t95") - F.unix_micros("t5")) / 86_400_000_000)
    )

    # a few rows per experiment from here on
    whole = Window.partitionBy("experiment")

    def control(column: str):
        return F.coalesce(F.max(F.when(F.col("variant") == "control", F.col(column))).over(whole), F.lit(0))

    paired = rates.select(
        "*", *[control(c).alias(f"c_{c}") for c in ("events", "hit_events", "views", "hits", "rate")]
    ).filter(F.col("variant") != "control")
    share = metrics.pooled_proportion(
        F.col("hit_events"), F.col("c_hit_events"), F.col("events"), F.col("c_events")
    )
    paired = paired.withColumn("pooled_sample_proportion", share)
    error = metrics.pooled_error(F.col("pooled_sample_proportion"), F.col("views"), F.col("c_views"))
    textbook = metrics.pooled_error_std(F.col("pooled_sample_proportion"), F.col("views"), F.col("c_views"))
    paired = paired.withColumn("pooled_standard_error", error).withColumn("pooled_standard_error_std", textbook).withColumn(
        "test", F.try_divide(F.col("rate") - F.col("c_rate"), F.col("pooled_standard_error"))
    )
    days = F.max("tdiff").over(whole)
    reached = F.col("c_hit_events") + F.sum("hit_events").over(whole)
    return paired.select(
        "experiment", "variant", "tdiff",
        F.col("events").alias("variant_experimentation_events"),
        F.col("c_events").alias("control_experimentation_events"),
        F.col("hit_events").alias("variant_conversion_events"),
        F.col("c_hit_events").alias("control_conversion_events"),
        F.col("views").alias("variant_experimentations"), F.col("c_views").alias("control_experimentations"),
        F.col("hits").alias("variant_conversions"), F.col("c_hits").alias("control_conversions"),
        F.col("rate").alias("variant_conversion_rate"), F.col("c_rate").alias("control_conversion_rate"),
        "topurl", instant_text(F.col("t95")).alias("time95"), instant_text(F.col("t5")).alias("time5"),
        "pooled_sample_proportion", "pooled_standard_error", "pooled_standard_error_std", "test",
        metrics.normal_cdf(-F.abs("test")).alias("p_value"),
        metrics.to_int(F.try_divide(days * threshold, reached) - days).alias("remaining_runtime"),
    ).orderBy("experiment", "variant")


def intervals(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    intervals: str = "2023-06-22,#target,2023-05-01,#mayday",
    conversioncheckpoint: str = "click",
) -> DataFrame:
    """Conversion rate and LCP per named interval, each tested against the last one."""
    named = named_intervals(intervals, p)
    wide = p.replace(device="all")
    ev = events(raw, wide, keys, TimeRange(named[0][1], p.as_of)).filter(F.col("weight") > 0)
    clicked = _converting(p.replace(sources="-"), conversioncheckpoint)
    # distinct click targets per id, then one row per id
    by_target = ev.groupBy("id", F.when(clicked, F.col("target")).alias("clicked")).agg(
        F.min(interval_number(F.col("time"), named)).alias("n"), F.min("lcp").alias("lcp")
    )
    by_id = by_target.groupBy("id").agg(
        F.min("n").alias("n"), F.min("lcp").alias("lcp"), F.count("clicked").alias("clicks")
    )
    table = by_id.filter(F.col("n").isNotNull()).groupBy("n").agg(
        F.count("id").alias("events"), F.sum("clicks").alias("conversions"), F.avg("lcp").alias("lcp_mean"),
        F.count("lcp").alias("lcp_count"), F.stddev_samp("lcp").alias("lcp_stddev"),
    )
    table = table.withColumn("rate", F.try_divide("conversions", "events")).withColumn(
        "stderr", F.try_divide("lcp_stddev", F.sqrt("lcp_count"))
    )
    # one row per interval from here on
    table = table.join(F.broadcast(interval_table(raw.sparkSession, named)), "n")
    last = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = ("n", "events", "conversions", "rate", "lcp_mean", "lcp_count", "stderr")
    table = table.select("*", *[F.first(c).over(last).alias(f"last_{c}") for c in columns])
    share = metrics.pooled_proportion(*map(F.col, ("conversions", "last_conversions", "events", "last_events")))
    error = metrics.pooled_error(share, F.col("events"), F.col("last_events"))
    rate_test = F.try_divide(F.abs(F.col("rate") - F.col("last_rate")), error)
    squares = (F.col("lcp_count") - 1) * F.pow("stderr", F.lit(2)) + (F.col("last_lcp_count") - 1) * F.pow(
        "last_stderr", F.lit(2)
    )
    freedom = F.col("lcp_count") + F.col("last_lcp_count") - 2
    spread = F.try_divide(F.sqrt(squares), F.sqrt(F.when(freedom > 0, freedom)))
    lcp_test = F.try_divide(F.abs(F.col("lcp_mean") - F.col("last_lcp_mean")), spread)
    earlier = F.col("n") != F.col("last_n")
    return table.filter(F.col("interval_name").isNotNull()).orderBy(F.col("n").desc()).select(
        "interval_name", "events", "conversions", F.col("rate").alias("conversion_rate"), "lcp_mean",
        "lcp_count", "lcp_stddev", instant_text(F.col("interval_start")).alias("interval_start"),
        instant_text(F.col("interval_end")).alias("interval_end"),
        F.when(earlier, 1 - metrics.normal_cdf(rate_test)).alias("conversion_p_value"),
        F.when(earlier, 1 - metrics.normal_cdf(lcp_test)).alias("lcp_p_value"),
    )


def vitals_correlation(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    conversioncheckpoint: str = "click",
    ntiles: int = 10,
) -> DataFrame:
    """Click rate per LCP tile, its correlation with LCP, and what a faster page could gain."""
    ev = events(raw, p.replace(device="all"), keys)
    clicked = _converting(p, conversioncheckpoint) & F.col("target").isNotNull()
    by_id = ev.groupBy("id").agg(
        F.min("lcp").alias("lcp"), F.max(F.when(clicked, 1).otherwise(0)).alias("clicks")
    ).filter(F.col("lcp").isNotNull())
    tiled = ntile(by_id, ntiles, "lcp", "id", name="lcp_percentile")
    rates = tiled.groupBy("lcp_percentile").agg(F.avg("lcp").alias("lcp"), F.avg("clicks").alias("click_rate"))
    rates = materialise(rates)  # one row per tile
    lcp, rate = F.col("lcp"), F.col("click_rate")
    good = (lcp <= 2500) & (F.col("lcp_percentile") > 1)
    overall = rates.agg(
        metrics.correlation(lcp, rate).alias("correlation"),
        metrics.correlation(F.when(good, lcp), F.when(good, rate)).alias("good_correlation"),
    )
    # the slowest tile that is less than a second slower than a best one; of several best ones the fastest
    # that is near enough
    most = rates.agg(F.max(rate)).scalar()
    best_lcps = rates.filter(rate == most).agg(F.sort_array(F.collect_list("lcp"))).scalar()
    near = F.filter(F.col("best_lcps"), lambda best: F.col("lcp") - best < 1000)
    boost = rates.withColumn("best_lcps", best_lcps).withColumn("best_lcp", F.get(near, 0))
    boost = boost.filter(F.col("best_lcp").isNotNull()).orderBy(lcp.desc()).limit(1)
    boost = boost.select(F.struct(
        F.try_divide(most - rate, rate).alias("gain"), (lcp - F.col("best_lcp")).alias("diff")
    )).scalar()
    whole = overall.select(F.struct("*")).scalar()
    return rates.withColumn("whole", whole).withColumn("boost", boost).orderBy("lcp_percentile").select(
        "lcp_percentile", "lcp", "click_rate", "whole.correlation", "whole.good_correlation",
        F.col("boost.gain").alias("click_rate_boost"), F.col("boost.diff").alias("lcp_diff"),
    )
