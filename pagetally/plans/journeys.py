"""What visitors do: checkpoint funnel, bounces, forms, raw bundles."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetally.functions import metrics
from pagetally.functions.timeframe import iso_text
from pagetally.operators.materialise import materialise
from pagetally.operators.ordering import page_after, running, top
from pagetally.operators.paging import Pages, write_pages
from pagetally.operators.percentile import exact_quantile, quantile_of_each
from pagetally.operators.popularity import estimate_views
from pagetally.operators.scan import by_text_keys, checkpoints, events
from pagetally.params import ReportParams


def checkpoint_funnel(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """Views per checkpoint and for any checkpoint, with the loss from one to the next."""
    ev = events(raw, p, keys).filter(F.col("checkpoint").isNotNull())
    # every event counts for its checkpoint and for the row "any"; both collapse before the shuffle
    step = F.explode(F.array(
        F.struct(F.lit(False).alias("every"), F.col("checkpoint").alias("checkpoint")),
        F.struct(F.lit(True).alias("every"), F.lit("any").alias("checkpoint")),
    ))
    rows = ev.select("id", "weight", step.alias("step")).select("id", "weight", "step.*")
    by_id = rows.groupBy("every", "checkpoint", "id").agg(F.max("weight").alias("weight"))
    steps = by_id.groupBy("every", "checkpoint").agg(
        F.count("id").alias("events"), F.sum("weight").alias("views")
    )
    # one row per checkpoint name
    ordered = Window.orderBy(F.col("views").desc(), "checkpoint")
    before = F.max("views").over(ordered.rowsBetween(-1, 0))
    most = F.max("views").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def percent(whole):
        return F.try_divide(F.col("views") * F.lit(100.0), whole)

    return steps.select(
        "checkpoint", "events", "views",
        F.coalesce(F.round(100 - percent(before), 1), F.lit(0.0)).alias("percent_dropoff"),
        F.coalesce(F.round(percent(most), 1), F.lit(0.0)).alias("percent_total"),
    ).orderBy(F.col("views").desc(), "checkpoint")


def bounces(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """Visits, pages per visit, bounce rate and durations, as one row. What cannot be told is null."""
    cp = checkpoints(events(raw, p, keys))
    paged = F.col("checkpoint") == "pagesviewed"
    entered = F.col("checkpoint") == "enter"
    clicked = (F.col("checkpoint") == "click") & F.col("target").isNotNull()
    # one row per page view and number of pages seen, then one row per page view
    seen = cp.groupBy(
        "id", "hostname", F.coalesce(paged, F.lit(False)).alias("paged"),
        F.when(paged, F.expr("try_cast(source AS bigint)")).alias("pages"),
    ).agg(
        F.max("pageviews").alias("pageviews"), F.min("time").alias("first"), F.max("time").alias("last"),
        F.max(entered).alias("entered"), F.max(clicked).alias("clicked"),
    )
    views = materialise(seen.groupBy("id", "hostname").agg(
        F.max("pageviews").alias("pageviews"),
        (F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))).alias("micros"),
        F.max("entered").alias("entered"), F.max("clicked").alias("clicked"),
        F.sum(F.when(F.col("paged"), F.col("pageviews"))).alias("paged_views"),
        F.sum("pages").alias("pages"), F.count("pages").alias("readings"),
    ))
    per_visit = 2 * (F.try_divide(F.sum("pages"), F.sum("readings")) - 1)
    sites = views.filter(F.col("paged_views").isNotNull()).groupBy("hostname").agg(
        F.sum("paged_views").alias("pageviews"), per_visit.alias("pagespervisit")
    )
    visits = sites.agg(
        F.sum("pageviews").alias("paged_views"),
        metrics.to_int(F.sum(F.try_divide("pageviews", "pagespervisit"))).alias("visits"),
        F.avg("pagespervisit").alias("pagespervisit"),
    )
    all_views = views.agg(F.coalesce(F.sum("pageviews"), F.lit(0))).scalar()
    seconds = views.select(F.floor(F.col("micros") / 1_000_000).alias("seconds"))
    duration = exact_quantile(seconds, [], "seconds", 0.5, "duration").scalar()
    enters = views.groupBy("id").agg(F.max("entered").alias("entered"), F.max("clicked").alias("clicked"))
    stayed = F.count_if(F.col("entered") & ~F.coalesce("clicked", F.lit(False)))
    rate = enters.agg(F.try_divide(stayed, F.count_if("entered"))).scalar()

    def positive(value):
        return F.when(value > 0, value)

    row = visits.select(
        "*", all_views.alias("all_views"), duration.alias("duration"), rate.alias("bounce_rate")
    )
    return row.select(
        F.greatest(F.coalesce("paged_views", F.lit(0)), "all_views").alias("pageviews"),
        positive(F.col("visits")).alias("visits"),
        positive(F.col("pagespervisit")).alias("pagespervisit"),
        positive(F.col("bounce_rate")).alias("bounce_rate"),
        positive(F.col("duration")).alias("pageview_duration"),
        positive(metrics.to_int(positive(F.col("pagespervisit")) * F.col("duration"))).alias("visit_duration"),
    )


def forms(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """Form views, submissions and vitals per url."""
    ev = events(raw, p, keys)
    source = F.col("source")
    viewed = (F.col("checkpoint") == "viewblock") & source.isin(".form", ".marketo")
    sent = (F.col("checkpoint") == "formsubmit") & (
        source.contains(".form") | source.contains("mktoForm") | source.contains(".marketo")
    )
    vitals = ("lcp", "fid", "inp", "cls")
    # one look at the events: a row for each form event of a page load, and one for all its other events
    tags = [F.when(viewed | sent, F.col(c)).alias(f"_{c}") for c in ("checkpoint", "source", "target")]
    tagged = by_text_keys(ev.select("id", "url", "weight", *vitals, *tags), "id", "_checkpoint", "_source", "_target").agg(
        F.max("weight").alias("pageviews"), F.min("url").alias("url"), F.max("url").alias("_last_url"),
        *[F.max(v).alias(v) for v in vitals],
    )
    tagged = materialise(tagged.drop("_hash"))
    cp = tagged.filter(F.col("_checkpoint").isNotNull()).select(
        "id", "url", "pageviews", F.col("_checkpoint").alias("checkpoint"), F.col("_source").alias("source")
    )
    per_source = estimate_views(cp, ["url", "checkpoint", "source"])
    per_url = per_source.groupBy("url").agg(
        F.sum(F.when(F.col("checkpoint") == "viewblock", F.col("views"))).alias("views"),
        F.sum(F.when(F.col("checkpoint") == "formsubmit", F.col("actions"))).alias("submissions"),
    )
    best = materialise(top(per_url.filter(F.col("views").isNotNull()), p.limit, "views", "url"))

    by_id = tagged.groupBy("id").agg(
        F.max("_last_url").alias("url"), F.max("pageviews").alias("weight"), *[F.max(v).alias(v) for v in vitals]
    )

    def whole(vital, value):
        return F.round(value, 3) if vital == "cls" else metrics.to_int(value)

    shown = materialise(by_id.join(best.select("url"), "url", "left_semi"))
    p75 = quantile_of_each(shown, ["url", "weight"], list(vitals), 0.75)
    p75 = p75.select("url", "weight", *[whole(v, F.col(v)).alias(v) for v in vitals])
    # a weight without readings still counts in the mean
    by_weight = shown.select("url", "weight").distinct().join(p75, ["url", "weight"], "left")
    by_url = by_weight.groupBy("url").agg(
        *[whole(v, metrics.weighted_mean(F.col(v), F.col("weight"))).alias(f"avg{v}") for v in vitals]
    )
    return best.join(by_url, "url", "left").orderBy(F.col("views").desc(), "url").select(
        "url", "views", "avglcp", "avgcls", "avginp", "avgfid",
        F.coalesce("submissions", F.lit(0)).alias("submissions"),
    )


# Events of one bundle row; a longer bundle goes on in rows of its own.
BUNDLE_EVENTS = 10_000


def _bundle_events(raw: DataFrame, p: ReportParams, keys: DataFrame | None) -> DataFrame:
    return events(raw, p.replace(offset=-1, interval=-1, enddate=p.startdate, timezone="UTC"), keys)


def bundle_heads(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    """One row per page view of the day, without its events. Write it once to read page after page."""
    return _bundle_events(raw, p, keys).groupBy("id", "url").agg(
        F.min("time").alias("start"), F.min("weight").cast("bigint").alias("weight"),
        F.min("user_agent").alias("user_agent"),
    )


def bundle_pages(heads: DataFrame, path: str) -> Pages:
    """Bundle heads written once to be paged through by position."""
    return write_pages(heads, path, "start", "id", "url")


def bundles(
    raw: DataFrame,
    p: ReportParams,
    keys: DataFrame | None = None,
    after: str = "unset",
    bundle_events: int = BUNDLE_EVENTS,
    heads: DataFrame | Pages | None = None,
) -> DataFrame:
    """One page of raw page views of the UTC day ``startdate``, each with its events.

    Pages are cut over the bundle heads (given as a written table or as ``bundle_pages``, or computed); only the events of
    the page's bundles are then gathered.
    Events are in order of time. A row holds at most ``bundle_events`` of them: events 0, 1, … of a bundle
    are in ``part`` 0, the next as many in part 1, all with the bundle's row number, so no row grows with a busy id.
    """
    cursor = None if after in ("unset", "-") else after
    if isinstance(heads, Pages):
        page = materialise(heads.after(cursor, p.limit))
    else:
        table = bundle_heads(raw, p, keys) if heads is None else heads
        page = materialise(page_after(table, ["start", "id", "url"], cursor, p.limit, stored=heads is not None))
    ev = _bundle_events(raw, p, keys)

    vital = [("lcp", "cwv-lcp"), ("inp", "cwv-inp"), ("cls", "cwv-cls"), ("ttfb", "cwv-ttfb")]
    name, value = F.col("checkpoint"), F.coalesce(*[F.col(v) for v, _ in vital])
    for column, label in reversed(vital):
        name = F.when(F.col(column).isNotNull(), label).otherwise(name)
    detail = ev.select("id", "url", "time", name.alias("checkpoint"), "source", "target", value.alias("value"))
    # copies of an event collapse to a count before the shuffle and are given back in their parts
    event = ["time", "checkpoint", "source", "target", "value"]
    wanted = detail.join(page.select("id", "url"), ["id", "url"])
    counted = wanted.groupBy("id", "url", *event).agg(F.count(F.lit(1)).alias("copies"))
    placed = running(counted, ["id", "url"], event, "copies").withColumn("_end", F.col("_before") + F.col("copies"))
    parts = F.sequence(F.floor(F.col("_before") / bundle_events), F.floor((F.col("_end") - 1) / bundle_events))
    cut = placed.withColumn("part", F.explode(parts))
    low, high = F.col("part") * bundle_events, (F.col("part") + 1) * bundle_events
    here = (F.least("_end", high) - F.greatest("_before", low)).cast("int")
    one = F.struct(iso_text(F.col("time")).alias("time"), "checkpoint", "source", "target", "value")
    keyed = F.struct(*event, F.array_repeat(one, here).alias("rows"))
    gathered = cut.groupBy("id", "url", "part").agg(F.sort_array(F.collect_list(keyed)).alias("sorted"))
    listed = gathered.select("id", "url", "part", F.flatten("sorted.rows").alias("events"))
    return listed.join(page, ["id", "url"]).orderBy("rownum", "part").select(
        "id", "url", iso_text(F.col("start")).alias("time"), "weight", "user_agent", "events", "rownum", "part"
    )
