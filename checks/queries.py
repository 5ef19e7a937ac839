"""One query per operator and report, over the supplied tables as a whole."""
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views
from pagetally.functions import filters, metrics, sql
from pagetally.functions import fixed_values as fixed
from pagetally.functions.timeframe import as_instant, instant_text, time_range, truncate
from pagetally.operators import access, ordering, percentile, popularity, scan, sketches, slots
from pagetally.operators.intervals import interval_join
from pagetally.operators.materialise import materialise
from pagetally.params import ReportParams
from pagetally.plans import (
    content_requests as content, dashboard as dash, journeys, popularity as popular, request_log, score,
    statistics, table_jobs, traffic,
)
from pagetally.sources import export, files, snapshots
from pagetally.sources.files import KEY_SCHEMA

Query = Callable[[SparkSession, str], DataFrame]

# The supplied events are of January 2024.
P = ReportParams(as_of=datetime(2024, 2, 1), interval=31)
END_OF_JANUARY = P.replace(as_of=datetime(2024, 1, 31))
HALF = P.replace(interval=16, limit=10)
DATES = P.replace(interval=-1, offset=-1, startdate="2024-01-01", enddate="2024-01-31")
NAMED = "2024-01-20,late,2024-01-01,early,2024-01-10,middle"

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = tidied(function)
    return function


def tidied(function: Query) -> Query:
    """Comparable output: floats to six digits, whole numbers as bigint, moments and nested values as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = function(spark, sf_dir)
        return df.selectExpr(*[_plain(field) for field in df.schema.fields])

    run.__name__ = function.__name__
    return run


def _plain(field: T.StructField) -> str:
    column, kind = f"`{field.name}`", field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = f"round(CAST({column} AS double), 6)"
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        value = f"CAST({column} AS bigint)"
    elif isinstance(kind, T.TimestampType):
        value = f"date_format({column}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    elif isinstance(kind, T.DateType):
        value = f"CAST({column} AS string)"
    elif isinstance(kind, (T.ArrayType, T.StructType)):
        value = f"to_json({column}, map('ignoreNullFields', 'false'))"
    else:
        return column
    return f"{value} AS {column}"


def events(spark: SparkSession, sf_dir: str, p: ReportParams = P) -> DataFrame:
    return scan.events(views.rum(spark, sf_dir), p)


# ---- scans, filters, roll-ups

@query
def scan_events_v5(spark, sf_dir):
    return events(spark, sf_dir)


@query
def scan_events_v3(spark, sf_dir):
    p = DATES.replace(startdate="2024-01-05", enddate="2024-01-20", device="mobile")
    return scan.events_v3(views.rum(spark, sf_dir), p)


@query
def scan_cluster_generation(spark, sf_dir):
    p = P.replace(url="blog.example.com")
    return scan.cluster_events(views.rum(spark, sf_dir), p, "gen-1").select("id", "time", "url", "generation")


@query
def scan_by_key(spark, sf_dir):
    rum, keys = views.rum(spark, sf_dir), views.keys(spark, sf_dir)
    # live for one site, in many rows; asked for one host of it; revoked; global
    cases = [("key-1", "www.example.com"), ("key-1", "shop.example.org"), ("key-0", "www.example.com"), ("key-10", "-")]
    parts = []
    for secret, url in cases:
        seen = scan.events(rum, P.replace(domainkey=secret, url=url), keys)
        parts.append(seen.select(F.lit(secret).alias("secret"), F.lit(url).alias("wanted"), "hostname", "id"))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.groupBy("secret", "wanted", "hostname").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")
    )


@query
def scan_by_key_of_many_sites(spark, sf_dir):
    """A secret that opens hundreds of sites."""
    keys = views.keys(spark, sf_dir).filter("hostname_prefix <> ''").withColumn("key_bytes", access.key_digest("wide"))
    wanted = ",".join(["www.example.com", "blog.example.com", "shop.example.org"] + [f"c{i}.example.net" for i in range(400)])
    seen = scan.events(views.rum(spark, sf_dir), P.replace(domainkey="wide", url=wanted), keys)
    return seen.groupBy("hostname").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query
def url_match_modes(spark, sf_dir):
    ev = events(spark, sf_dir)
    queried = F.concat("url", F.when(F.col("weight") == 10, "?a=1").otherwise(""))
    ev = ev.withColumn("url", queried)
    modes = [
        "-", "www.example.com", "www.example.com/p1", "www.example.com/p1$", "www.example.com/p1?",
        "localhost:3000", "www.example.com, blog.example.com,",
    ]
    counts = []
    for mode in modes:
        hit = filters.page_matches(F.col("url"), F.col("hostname"), mode)
        counts.append(F.count(F.lit(1)) if hit is None else F.count_if(hit))
    return _as_rows(ev, list(zip(modes, counts)), "mode")


def _as_rows(df: DataFrame, named: list[tuple[str, Column]], name: str) -> DataFrame:
    """Several counts of one pass as rows (name, n)."""
    row = df.agg(*[count.alias(f"c{i}") for i, (_, count) in enumerate(named)])
    pairs = [F.struct(F.lit(label).alias(name), F.col(f"c{i}").alias("n")) for i, (label, _) in enumerate(named)]
    return row.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


@query
def device_class(spark, sf_dir):
    ev = events(spark, sf_dir)
    agent = F.col("user_agent")
    raw = (
        F.when(agent.startswith("mobile"), "Mozilla/5.0 (Phone) Mobile").when(agent.startswith("bot"), "curl/8")
        .otherwise("Mozilla/5.0 (X11)")
    )
    named = []
    for device in ("all", "desktop", "mobile", "bot", "nobot", "fridge"):
        hit = filters.device_class(agent, device)
        named.append((device, F.count(F.lit(1)) if hit is None else F.count_if(hit)))
    for device in ("desktop", "mobile", "bot"):
        named.append((f"raw {device}", F.count_if(filters.raw_device_class(raw, device))))
    return _as_rows(ev, named, "device")


@query
def time_range_bounds(spark, sf_dir):
    rum = views.rum(spark, sf_dir)
    cases = {
        "last 7 days": P.replace(interval=7),
        "offset 10": P.replace(interval=7, offset=10),
        "pacific": P.replace(interval=7, offset=5, timezone="America/Los_Angeles"),
        "no zone": P.replace(interval=7, offset=5, timezone="undefined"),
        "dates": DATES.replace(startdate="2024-01-05", enddate="2024-01-06"),
        "dates in tokyo": DATES.replace(startdate="2024-01-05", enddate="2024-01-06", timezone="Asia/Tokyo"),
        "cut at now": DATES.replace(startdate="2024-01-05", as_of=datetime(2024, 1, 10, 12)),
    }
    spans = {name: time_range(p) for name, p in cases.items()}
    spans["closed dates"] = time_range(cases["dates"], closed=True)
    spans["before"] = spans["last 7 days"].before()
    named = [(name, F.count_if(span.contains(F.col("time")))) for name, span in spans.items()]
    return _as_rows(rum, named, "span")


@query
def prefix_list_exists(spark, sf_dir):
    ev = events(spark, sf_dir).filter(filters.starts_with_any(F.col("source"), "src1, src3 ,.fo"))
    return ev.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def host_exclusions(spark, sf_dir):
    ev = views.rum(spark, sf_dir)
    # each event under its own and under other kinds of host
    kinds = F.explode(F.array(
        F.col("hostname"), F.lit("10.0.0.1"), F.lit("localhost"), F.lit("docs.google.com"), F.lit("www.hlx.live"),
        F.lit("x.hlx.page"), F.lit(""), F.lit("a.aem.live"),
    ))
    host = F.col("name")
    rows = ev.select(kinds.alias("name"))
    lists = {
        "pivot": filters.public_hosts(host, fixed.EXCLUDED_SUFFIXES_PIVOT, fixed.READMITTED_HOST),
        "content": filters.public_hosts(host, fixed.EXCLUDED_SUFFIXES_CONTENT),
        "golive": filters.without_suffix(host, fixed.EXCLUDED_SUFFIXES_GOLIVE),
    }
    return rows.groupBy("name").agg(*[F.count_if(kept).alias(name) for name, kept in lists.items()])


@query
def rollup_pageviews(spark, sf_dir):
    return scan.pageviews(events(spark, sf_dir))


@query
def rollup_checkpoints(spark, sf_dir):
    return scan.checkpoints(events(spark, sf_dir))


@query
def urls_from_list(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer")
    entry = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.com"))
    text = F.concat(entry, F.lit(", www."), entry, F.lit(",,"))
    return slots.urls_from_list(customers.select("c_custkey", text.alias("list")), "list").drop("list")


@query
def sql_functions(spark, sf_dir):
    """The scan and roll-ups as SQL table functions."""
    views.rum(spark, sf_dir).createOrReplaceTempView("raw_rum_events")
    sql.register(spark, "raw_rum_events")
    span = "TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01'"
    return spark.sql(f"""
        SELECT hostname, user_agent, count(*) AS n, sum(pageviews) AS views, margin_of_error(max(pageviews), count(*)) AS margin
        FROM rum_pageviews('www.example.com,blog.example.com', {span}, 'nobot') GROUP BY hostname, user_agent
        UNION ALL
        SELECT hostname, checkpoint, count(*), sum(pageviews), normal_cdf(count(*) / 100D)
        FROM rum_checkpoints('shop.example.org/p1', {span}, 'mobile') GROUP BY hostname, checkpoint""")


def _sql(spark, sf_dir):
    views.rum(spark, sf_dir).createOrReplaceTempView("raw_rum_events")
    views.keys(spark, sf_dir).createOrReplaceTempView("access_keys")
    sql.register(spark, "raw_rum_events", "access_keys")


@query
def sql_older_scans(spark, sf_dir):
    """The two older scans and their roll-ups as SQL table functions."""
    _sql(spark, sf_dir)
    older = "TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20', 'mobile'"
    cluster = "TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', 'all', 'gen-1'"
    return spark.sql(f"""
        SELECT 'events' AS of, hostname, CAST(NULL AS STRING) AS generation, count(*) AS n, CAST(sum(weight) AS BIGINT) AS views FROM rum_events_v3('-', {older}) GROUP BY hostname
        UNION ALL SELECT 'pageviews', hostname, NULL, count(*), CAST(sum(pageviews) AS BIGINT) FROM rum_pageviews_v3('-', {older}) GROUP BY hostname
        UNION ALL SELECT 'checkpoints', hostname, NULL, count(*), CAST(sum(pageviews) AS BIGINT) FROM rum_checkpoints_v3('-', {older}) GROUP BY hostname
        UNION ALL SELECT 'cluster events', hostname, generation, count(*), CAST(sum(weight) AS BIGINT) FROM cluster_events('blog.example.com', {cluster}) GROUP BY hostname, generation
        UNION ALL SELECT 'cluster pageviews', hostname, generation, count(*), CAST(sum(pageviews) AS BIGINT) FROM cluster_pageviews('blog.example.com', {cluster}) GROUP BY hostname, generation
        UNION ALL SELECT 'cluster checkpoints', hostname, generation, count(*), CAST(sum(pageviews) AS BIGINT) FROM cluster_checkpoints('blog.example.com', {cluster}) GROUP BY hostname, generation""")


@query
def sql_events_by_key(spark, sf_dir):
    """What a secret opens, by the keyed SQL table function."""
    _sql(spark, sf_dir)
    cases = [("key-1", "www.example.com"), ("key-1", "shop.example.org"), ("key-0", "www.example.com"), ("key-10", "-")]
    return spark.sql(" UNION ALL ".join(f"""
        SELECT '{secret}' AS secret, '{wanted}' AS wanted, hostname, count(*) AS n, count(DISTINCT id) AS ids FROM rum_events_keyed(
            '{wanted}', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', 'all', '{secret}', DATE '2024-02-01') GROUP BY hostname""" for secret, wanted in cases))


@query
def sql_rollups_by_key(spark, sf_dir):
    _sql(spark, sf_dir)
    taken = "'www.example.com', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', 'all', 'key-1', DATE '2024-02-01'"
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{name}' AS of, hostname, count(*) AS n, CAST(sum(pageviews) AS BIGINT) AS views FROM {name}_keyed({taken}) GROUP BY hostname"
        for name in ("rum_pageviews", "rum_checkpoints", "rum_pageviews_v3", "rum_checkpoints_v3")))


@query
def sql_key_privileges(spark, sf_dir):
    _sql(spark, sf_dir)
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{secret}' AS secret, read, write FROM key_privileges('{secret}', DATE '2024-02-01')" for secret in ("key-0", "key-1", "key-10", "unknown")))


@query
def events_of_two_collectors(spark, sf_dir):
    """Two written collectors, of which one has no TTFB, read as one table by date."""
    rum, folder = views.rum(spark, sf_dir), views.scratch(spark)
    first = F.coalesce(F.col("weight") == 100, F.lit(False))
    files.write_events(rum.filter(first), f"{folder}/one")
    files.write_events(rum.filter(~first).drop("ttfb"), f"{folder}/two")
    ev = scan.events(files.read_events(spark, f"{folder}/one", f"{folder}/two"), P.replace(interval=14))
    return ev.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("views"), F.count("ttfb").alias("readings"), F.count("lcp").alias("lcps")
    )


@query
def events_on_days(spark, sf_dir):
    """Events of the days with most clicks, which are rows of another table: only their partitions are read."""
    folder = views.scratch(spark)
    files.write_events(views.rum(spark, sf_dir), folder)
    raw = files.read_events(spark, folder)
    clicks = raw.filter("checkpoint = 'click'").groupBy("event_date").agg(F.count(F.lit(1)).alias("clicks"))
    days = ordering.top(clicks, 5, "clicks", "event_date")
    return scan.on_days(raw, days, "event_date").groupBy("event_date", "checkpoint").agg(F.count(F.lit(1)).alias("n"))


# ---- generated rows

@query
def slots_by_granularity(spark, sf_dir):
    ev = events(spark, sf_dir)
    span = time_range(P)
    parts = []
    for size, unit in slots.UNITS.items():
        counts = ev.groupBy(truncate(F.col("time"), unit, "America/New_York").alias("slot")).agg(
            F.count(F.lit(1)).alias("n")
        )
        grid = slots.slots(spark, span, unit, "America/New_York")
        parts.append(grid.join(counts, "slot", "left").select(
            F.lit(size).alias("granularity"), instant_text(F.col("slot"), "America/New_York").alias("slot"),
            F.coalesce("n", F.lit(0)).alias("n"),
        ))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query
def named_intervals(spark, sf_dir):
    named = slots.named_intervals(NAMED, P)
    ev = events(spark, sf_dir)
    counts = ev.groupBy(slots.interval_number(F.col("time"), named).alias("n")).agg(F.count(F.lit(1)).alias("events"))
    return slots.interval_table(spark, named).join(counts, "n", "left")


@query
def range_join_intervals(spark, sf_dir):
    """The interval of every event, by an interval join with the interval rows."""
    ev = events(spark, sf_dir)
    named = slots.interval_table(spark, slots.named_intervals("2024-01-05,five,2024-01-15,fifteen", P))
    joined = interval_join(ev, named, "time", "interval_start", "interval_end", 7 * 86_400e6, "left")
    return joined.groupBy("interval_name", "checkpoint").agg(F.count(F.lit(1)).alias("events"))


# ---- aggregates

@query
def weighted_vitals(spark, sf_dir):
    pv = scan.pageviews(events(spark, sf_dir))
    return pv.groupBy("url").agg(*[
        metrics.weighted_mean(F.col(v), F.col("pageviews")).alias(v) for v in ("lcp", "fid", "inp", "cls", "ttfb")
    ])


@query
def good_bad_share(spark, sf_dir):
    pv = scan.pageviews(events(spark, sf_dir))
    shares = []
    for v in dash.VITALS:
        shares.append(metrics.percent_true(metrics.is_good(v, F.col(v))).alias(f"{v}good"))
        shares.append(metrics.percent_true(metrics.is_bad(v, F.col(v))).alias(f"{v}bad"))
    return pv.groupBy("url").agg(*shares)


@query
def p75_exact(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    return percentile.exact_quantile(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.75, "p75")


@query
def p75_sketch(spark, sf_dir):
    pv = scan.pageviews(events(spark, sf_dir))
    return pv.groupBy("hostname").agg(*[metrics.p75(F.col(v)).alias(v) for v in dash.VITALS])


@query
def sketched_vitals(spark, sf_dir):
    """Whether the sketched 75th percentile of each host lies within its rank error, and the number of urls within its own."""
    ev = events(spark, sf_dir).filter("lcp is not null")
    made = sketches.sketches(ev, ["hostname"], ["lcp"], ["url"]).select(
        "hostname", sketches.sketched_quantile("lcp", 0.75).alias("q"), sketches.sketched_count("url").alias("urls")
    )
    judged = ev.join(made, "hostname").groupBy("hostname", "urls").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lcp") < F.col("q")).alias("below"), F.count_if(F.col("lcp") <= F.col("q")).alias("upto"),
        F.count_distinct("url").alias("exact_urls"),
    )
    slack = F.col("n") * 1.7 / sketches.K + 1
    return judged.select(
        "hostname", "n", ((F.col("below") - slack <= 0.75 * F.col("n")) & (F.col("upto") + slack >= 0.75 * F.col("n"))).alias("quantile_holds"),
        (F.abs(F.col("urls") - F.col("exact_urls")) <= 0.05 * F.col("exact_urls") + 1).alias("count_holds"),
    )


@query
def top_value_count(spark, sf_dir):
    return popularity.top_value_by_count(events(spark, sf_dir), ["url"], "source", "top_source")


@query
def top_value_sum(spark, sf_dir):
    return popularity.top_value_by_sum(events(spark, sf_dir), ["url"], "source", "weight", "top_source")


@query
def distinct_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("checkpoint").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"),
        F.count_distinct("user_agent").alias("agents"),
    )


@query
def estimated_views(spark, sf_dir):
    return popularity.estimate_views(scan.checkpoints(events(spark, sf_dir)), ["url", "checkpoint"])


@query
def pivot_months(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    months = [f"{m:02d}" for m in range(1, 13)]
    month = F.date_format("o_orderdate", "MM")
    return orders.withColumn("month", month).groupBy("o_orderpriority").pivot("month", months).agg(
        F.count(F.lit(1))
    ).select("o_orderpriority", *[F.coalesce(f"`{m}`", F.lit(0)).alias(f"m{m}") for m in months])


@query
def margin_of_error(spark, sf_dir):
    ev = events(spark, sf_dir)
    counts = ev.groupBy("hostname", "weight").agg(F.count(F.lit(1)).alias("n"))
    margin = metrics.margin_of_error(F.col("weight"), F.col("n"))
    fixed_z = metrics.margin_of_error(F.col("weight"), F.col("n"), 2.58)
    return counts.withColumn("margin", metrics.to_int(margin)).withColumn("wide", metrics.to_int(fixed_z))


@query
def normal_cdf(spark, sf_dir):
    raw = views.table(spark, sf_dir, "events")
    return raw.select("event_id", metrics.normal_cdf((F.col("value") - 100) / 40).alias("p"))


@query
def stddev_and_corr(spark, sf_dir):
    pv = scan.pageviews(events(spark, sf_dir))
    return pv.groupBy("hostname").agg(
        F.stddev_samp("lcp").alias("sd"),
        F.try_divide(F.stddev_samp("lcp"), F.sqrt(F.count("lcp"))).alias("se"),
        metrics.correlation(F.col("lcp"), F.col("pageviews").cast("double")).alias("corr"),
        metrics.correlation(F.col("lcp"), F.lit(1.0)).alias("flat"),
    )


@query
def two_levels(spark, sf_dir):
    """Two grouping levels of one set in one pass."""
    ev = events(spark, sf_dir)
    both = ev.groupingSets(
        [[F.col("source"), F.col("url")], [F.col("source")]], "source", "url"
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping("url").alias("total"))
    return both


@query
def rollup_chain(spark, sf_dir):
    """Day to month to year of request counts."""
    daily = content.daily_requests(events(spark, sf_dir))
    month = content.monthly_requests(daily)
    return month.groupBy("hostname", F.date_trunc("year", "start").alias("year")).agg(
        F.sum("cr_margin_of_error").alias("cr_margin_of_error"), *[F.sum(c).alias(c) for c in content.SUMS]
    )


# ---- order

@query
def top_n_other(spark, sf_dir):
    pv = scan.pageviews(events(spark, sf_dir))
    urls = materialise(pv.groupBy("url").agg(F.sum("pageviews").alias("views")))
    labelled = ordering.label_top(urls, 5, "views", "url")
    return labelled.groupBy("label").agg(F.sum("views").alias("views"), F.count(F.lit(1)).alias("urls"))


@query
def global_row_number(spark, sf_dir):
    raw = views.table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    return ordering.global_row_number(raw, "user_id", "ts", "event_id").select("event_id", "rownum")


@query
def ntile_lcp(spark, sf_dir):
    pv = scan.pageviews(events(spark, sf_dir)).filter(F.col("lcp").isNotNull())
    return ordering.ntile(pv.select("id", "lcp"), 7, "lcp", "id")


@query
def running_chain(spark, sf_dir):
    return score.url_days(events(spark, sf_dir)).select("url", "day", "step", "chain", "load", "click")


@query
def keyset_page(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice", "o_custkey")
    rows = materialise(rows)
    cursor = ordering.page_after(rows, ["o_totalprice", "id"], None, 40, stored=True).orderBy(F.col("rownum").desc()).first()["id"]
    return ordering.page_after(rows, ["o_totalprice", "id"], cursor, 25, stored=True)


@query
def full_outer_periods(spark, sf_dir):
    ev = scan.pageviews(events(spark, sf_dir))
    split = as_instant(datetime(2024, 1, 16))
    halves = [ev.filter(F.col("time") >= split), ev.filter(F.col("time") < split)]
    now, before = (
        h.groupBy("url", "user_agent").agg(F.sum("pageviews").alias(n)) for h, n in zip(halves, ("now", "before"))
    )
    return now.join(before, ["url", "user_agent"], "full")


@query
def bucket_lookup(spark, sf_dir):
    days = materialise(score.url_days(events(spark, sf_dir)))
    return days.withColumn("cuts", score.cut_points(days, ["lcp", "load"])).select(
        "url", "day", score.rank_up(F.col("lcp"), F.col("cuts.lcp")).alias("lcp_rank"),
        score.rank_down(F.col("load"), F.col("cuts.load")).alias("load_rank"),
    )


# ---- reports

@query
def dashboard(spark, sf_dir):
    return dash.dashboard(views.rum(spark, sf_dir), HALF)


@query
def dashboard_url(spark, sf_dir):
    return dash.dashboard(views.rum(spark, sf_dir), HALF.replace(url="www.example.com", limit=3, device="nobot"))


@query
def dashboard_rising(spark, sf_dir):
    return dash.dashboard(views.rum(spark, sf_dir), HALF, rising=True)


@query
def dashboard_repo(spark, sf_dir):
    rum = views.rum(spark, sf_dir)
    # the stand-in has no folder urls; give it some
    rum = rum.withColumn("url", F.concat("url", F.lit("/")))
    return dash.dashboard(rum, HALF.replace(limit=4), owner="acme", repo="site")


def _pageviews(name: str, granularity: int, p: ReportParams) -> None:
    def run(spark, sf_dir):
        return traffic.pageviews_over_time(views.rum(spark, sf_dir), p, granularity=granularity)

    run.__name__ = name
    query(run)


_pageviews("pageviews_hour", 24, P)
_pageviews("pageviews_day", 1, P)
_pageviews("pageviews_week", 7, P.replace(interval=6))
_pageviews("pageviews_month", 30, P.replace(interval=3))
_pageviews("pageviews_quarter", 90, P.replace(interval=3))
_pageviews("pageviews_year", 365, P.replace(interval=2))
_pageviews(
    "pageviews_filtered", 1,
    DATES.replace(checkpoint="click", sources="src1, src2", targets="https://t1,https://t2", timezone="Europe/Berlin"),
)


@query
def pageviews_pivot(spark, sf_dir):
    return traffic.pageviews_pivot(views.rum(spark, sf_dir), END_OF_JANUARY.replace(interval=365))


@query
def sources_aggregated(spark, sf_dir):
    return popular.sources(views.rum(spark, sf_dir), P)


@query
def sources_by_url(spark, sf_dir):
    return popular.sources(views.rum(spark, sf_dir), P.replace(checkpoint="click", limit=20), aggregate=False)


@query
def sources_targets(spark, sf_dir):
    return popular.sources_targets(views.rum(spark, sf_dir), P)


@query
def targets_split(spark, sf_dir):
    return popular.targets(views.rum(spark, sf_dir), P.replace(checkpoint="click"))


@query
def targets_extract(spark, sf_dir):
    return popular.targets(views.rum(spark, sf_dir), P.replace(source="src1"), extract="t[0-9]")


@query
def not_found(spark, sf_dir):
    return popular.not_found(views.rum(spark, sf_dir), P)


@query
def checkpoint_urls(spark, sf_dir):
    return popular.checkpoint_urls(views.rum(spark, sf_dir), P)


@query
def checkpoint_funnel(spark, sf_dir):
    return journeys.checkpoint_funnel(views.rum(spark, sf_dir), P.replace(device="nobot"))


@query
def bounces(spark, sf_dir):
    return journeys.bounces(views.rum(spark, sf_dir), P)


@query
def bundles(spark, sf_dir):
    return journeys.bundles(views.rum(spark, sf_dir), P.replace(startdate="2024-01-05", limit=1000))


@query
def bundles_page2(spark, sf_dir):
    rum, p = views.rum(spark, sf_dir), P.replace(startdate="2024-01-05", limit=20)
    heads = materialise(journeys.bundle_heads(rum, p))
    first = journeys.bundles(rum, p, heads=heads)
    return journeys.bundles(rum, p, after=first.orderBy(F.col("rownum").desc()).first()["id"], heads=heads)


@query
def bundles_page2_by_position(spark, sf_dir):
    """The same page from heads with a positional index."""
    rum, p = views.rum(spark, sf_dir), P.replace(startdate="2024-01-05", limit=20)
    heads = journeys.bundle_pages(journeys.bundle_heads(rum, p), views.scratch(spark))
    return journeys.bundles(rum, p, after=heads.at(1, p.limit).orderBy(F.col("rownum").desc()).first()["id"], heads=heads)


@query
def content_requests_month(spark, sf_dir):
    return content.content_requests(views.rum(spark, sf_dir), DATES)


@query
def content_requests_year(spark, sf_dir):
    return content.content_requests(views.rum(spark, sf_dir), DATES, granularity=365)


@query
def content_requests_page2(spark, sf_dir):
    rum = views.rum(spark, sf_dir)
    table = materialise(content.request_table(rum, DATES))
    first = content.content_requests(rum, DATES.replace(limit=1), table=table).first()["id"]
    return content.content_requests(rum, DATES.replace(limit=1), after=first, table=table)


@query
def content_requests_page2_by_position(spark, sf_dir):
    rum = views.rum(spark, sf_dir)
    table = content.request_pages(content.request_table(rum, DATES), views.scratch(spark))
    first = content.content_requests(rum, DATES.replace(limit=1), table=table).first()["id"]
    return content.content_requests(rum, DATES.replace(limit=1), after=first, table=table)


@query
def forms(spark, sf_dir):
    return journeys.forms(views.rum(spark, sf_dir), P)


@query
def experiments(spark, sf_dir):
    return statistics.experiments(views.rum(spark, sf_dir), P)


@query
def experiments_filtered(spark, sf_dir):
    p = P.replace(sources="src", targets="https://t1, https://t2, https://t3")
    return statistics.experiments(views.rum(spark, sf_dir), p, experiment="exp-1", threshold=900)


@query
def intervals(spark, sf_dir):
    p = P.replace(targets="https://, http://")
    return statistics.intervals(views.rum(spark, sf_dir), p, intervals=NAMED)


@query
def vitals_correlation(spark, sf_dir):
    return statistics.vitals_correlation(views.rum(spark, sf_dir), P)


@query
def experience_score(spark, sf_dir):
    return score.experience_score(views.rum(spark, sf_dir), P)


@query
def domain_list(spark, sf_dir):
    return traffic.domain_list(views.rum(spark, sf_dir), END_OF_JANUARY)


@query
def golive_hints(spark, sf_dir):
    rum = views.rum(spark, sf_dir)
    # all hosts of the stand-in are there from the first day on; some get another name on the last one
    renamed = (F.col("time") >= as_instant(datetime(2024, 1, 30))) & F.col("hostname").contains(".example.")
    rum = rum.withColumn("hostname", F.when(renamed, F.concat(F.lit("new."), "hostname")).otherwise(F.col("hostname")))
    return traffic.golive_hints(rum, END_OF_JANUARY)


@query
def dev_urls(spark, sf_dir):
    p = P.replace(as_of=datetime(2024, 1, 31))
    return request_log.dev_urls(views.requests(spark, sf_dir), p, "acme", "site")


@query
def guess_hostname(spark, sf_dir):
    return request_log.guess_hostname(views.requests(spark, sf_dir), P, ref="main")


# ---- keys and table jobs

@query
def key_privileges(spark, sf_dir):
    keys = views.keys(spark, sf_dir)
    parts = [
        access.privileges(keys, secret, P).select(F.lit(secret).alias("secret"), "read", "write")
        for secret in ("key-0", "key-1", "key-10", "unknown")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def rotate_keys(spark, sf_dir):
    folder = views.scratch(spark)
    snapshots.write(views.keys(spark, sf_dir), folder)
    p = P.replace(domainkey="key-10", url="example.com, shop.example.org,")
    table_jobs.rotate_keys(spark, folder, p, "fresh", grace_days=5, expiry="2025-01-01", note="rotated")
    table = snapshots.read(spark, folder, KEY_SCHEMA)
    new = F.col("key_bytes") == access.key_digest("fresh")
    return table.groupBy("hostname_prefix", "revoke_date", "readonly", "create_date", "note", new.alias("is_new")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def revoke_key(spark, sf_dir):
    folder = views.scratch(spark)
    snapshots.write(views.keys(spark, sf_dir), folder)
    p = P.replace(domainkey="key-10", url="example.com")
    table_jobs.revoke_key(spark, folder, p, "key-1", grace_days=3)
    table = snapshots.read(spark, folder, KEY_SCHEMA)
    return table.groupBy("hostname_prefix", "revoke_date").agg(F.count(F.lit(1)).alias("n"))


@query
def upsert_domain_info(spark, sf_dir):
    folder = views.scratch(spark)
    snapshots.write(views.domains(spark, sf_dir), folder)
    p = P.replace(domainkey="key-10")
    return table_jobs.update_domain_info(
        spark, folder, views.keys(spark, sf_dir), p, views.domain_changes(spark, sf_dir)
    )


@query
def add_audit_scores(spark, sf_dir):
    p = P.replace(domainkey="key-10")
    return table_jobs.add_audits(
        spark, views.scratch(spark), views.keys(spark, sf_dir), p, views.audits(spark, sf_dir)
    )


# ---- results

@query
def nested_rows(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    event = F.concat(F.lit('{"event": "page_view", "url": "'), "url", F.lit('"}'))
    meta = F.struct(F.lit("foo").alias("foo"), (F.col("page_id") % 10).alias("bar"))
    return pages.select(
        "page_id", (F.col("page_id") % 2 == 0).alias("is_admin"), F.array(event, F.col("url")).alias("events"),
        meta.alias("metadata"), F.array(meta, F.struct(F.lit("foo").alias("foo"), F.col("page_id").alias("bar"))).alias("meta_array"),
    )


@query
def csv_export(spark, sf_dir):
    raw = views.table(spark, sf_dir, "events")
    return export.csv_lines(raw.select("event_id", "props", (F.col("user_id") % 2 == 0).alias("even"), "event_type", (F.col("user_id") / 4).alias("quarter")))


@query
def sheet_export(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    return export.sheet_rows(pages.select("page_id", "url", F.nullif(F.col("page_id") % 3, F.lit(0)).alias("rest")))


@query
def size_cap(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return ordering.delivery_parts(rows, "o_orderkey", max_bytes=40_000)


@query
def plot_points(spark, sf_dir):
    funnel = journeys.checkpoint_funnel(views.rum(spark, sf_dir), P)
    return funnel.select(metrics.points(("checkpoint", "views")).alias("point"))
