"""Experience score: letters per host from terciles of speed, reach and engagement."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetally.functions import filters, metrics
from pagetally.functions import fixed_values as fixed
from pagetally.operators.materialise import materialise
from pagetally.operators.percentile import exact_quantiles
from pagetally.operators.scan import events
from pagetally.params import ReportParams

CUTS = [0.0, 1 / 3, 2 / 3, 1.0]
LOW_IS_GOOD = ("cls", "lcp", "fid", "inp")
HIGH_IS_GOOD = ("load", "click")


def url_days(ev: DataFrame) -> DataFrame:
    """Daily means per url, with the running number of day-to-day returns as ``chain``."""

    def seen(checkpoint: str) -> Column:
        return F.max(F.when(F.col("checkpoint") == checkpoint, 1).otherwise(0)).alias(checkpoint)

    views = ev.groupBy("id").agg(
        filters.strip_query(F.min("url")).alias("url"), F.min("hostname").alias("host"),
        F.date_trunc("day", F.max("time")).alias("day"),
        *[F.max(v).alias(v) for v in LOW_IS_GOOD], seen("top"), seen("load"), seen("click"),
    )
    per_top = {
        c: F.least(F.coalesce(F.try_divide(F.sum(c), F.sum("top")), F.lit(0.0)), F.lit(1.0)).alias(c)
        for c in HIGH_IS_GOOD
    }
    days = views.groupBy("day", "url").agg(
        F.max("host").alias("host"),
        *[F.avg(v).alias(v) for v in LOW_IS_GOOD], *per_top.values(),
    )
    order = Window.partitionBy("url").orderBy("day")
    days = days.withColumn("step", F.datediff("day", F.lag("day").over(order)))
    return days.withColumn("chain", F.count_if(F.col("step") == 1).over(order))


def cut_points(table: DataFrame, names: list[str]) -> Column:
    """Four cut points of the distinct values of each metric, as one struct; one pass over all metrics."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names
    ]))
    values = table.select(pairs.alias("v")).select("v.*").filter(F.col("value").isNotNull()).distinct()
    shares = {f"c{i}": share for i, share in enumerate(CUTS)}
    cuts = exact_quantiles(values, ["metric"], "value", shares).select("metric", F.array(*shares).alias("cuts"))
    return cuts.agg(F.struct(*[
        F.max(F.when(F.col("metric") == m, F.col("cuts"))).alias(m) for m in names
    ])).scalar()


def rank_up(value: Column, cuts: Column) -> Column:
    """Largest index of a cut point that is not above the value."""
    found = F.lit(None).cast("int")
    for i in range(4):
        found = F.when(cuts[i] <= value, F.lit(i)).otherwise(found)
    return found


def rank_down(value: Column, cuts: Column) -> Column:
    """Smallest index into the descending cut points that the value reaches."""
    found = F.lit(None).cast("int")
    for i in range(3, -1, -1):
        found = F.when(value >= cuts[3 - i], F.lit(i)).otherwise(found)
    return found


def experience_score(raw: DataFrame, p: ReportParams, keys: DataFrame | None = None) -> DataFrame:
    days = materialise(url_days(events(raw, p.replace(device="all"), keys)))
    hosts = days.groupBy("host").agg(
        *[F.avg(c).alias(c) for c in LOW_IS_GOOD + HIGH_IS_GOOD],
        F.count_if(F.col("chain") == 1).alias("reach"), F.count_if(F.col("chain") == 7).alias("persistence"),
    )
    powered = hosts.filter((F.col("reach") > 0) & (F.col("persistence") > 0) & F.col("host").isNotNull())
    day_cuts = cut_points(days, list(LOW_IS_GOOD + HIGH_IS_GOOD))
    host_cuts = cut_points(powered, ["reach", "persistence"])
    scored = hosts.filter(
        F.col("host").isNotNull() & ~F.col("host").contains(fixed.UNSCORED_HOST_INFIX)
        & (F.col("host") != "localhost")
    )
    if p.url != "-":
        scored = scored.filter(F.col("host") == p.url)
    scored = scored.withColumn("day", day_cuts).withColumn("power", host_cuts)
    up = {m: rank_up(F.col(m), F.col(f"day.{m}")) for m in ("cls", "lcp", "fid")}
    down = {m: rank_down(F.col(m), F.col(f"day.{m}")) for m in HIGH_IS_GOOD}
    down |= {m: rank_down(F.col(m), F.col(f"power.{m}")) for m in ("reach", "persistence")}
    ranks = scored.select(
        "host", *[c.alias(f"{m}_rank") for m, c in {**up, **down}.items()]
    )
    if p.url == "-":
        ranks = ranks.dropna()

    def mean(*names: str) -> Column:
        return sum((F.col(f"{n}_rank") for n in names[1:]), F.col(f"{names[0]}_rank")) / len(names)

    speed, audience = mean("cls", "lcp", "fid"), mean("reach", "persistence", "load")
    engagement = F.col("click_rank")
    return ranks.orderBy(F.regexp_extract("host", r"\..*", 0), "host").select(
        "host",
        metrics.letter((speed + audience + engagement) / 3).alias("experiencescore"),
        metrics.letter(speed).alias("perfscore"), metrics.letter(audience).alias("audiencescore"),
        metrics.letter(engagement).alias("engagementscore"),
    )
