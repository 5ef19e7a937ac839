"""The queries of ``checks.queries`` in SQL, written from the report definitions for DuckDB."""
from __future__ import annotations

from checks.views import sql_views

ORACLES: dict[str, str] = {}

VITALS = ("lcp", "fid", "inp", "cls", "ttfb")
GOOD = {"lcp": 2500, "fid": 100, "inp": 200, "cls": 0.1, "ttfb": 800}
BAD = {"lcp": 4000, "fid": 300, "inp": 500, "cls": 0.25, "ttfb": 1800}
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
SECONDS = "'%Y-%m-%d %H:%M:%S'"
ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"
VALID = r"weight IN (1, 10, 20, 100, 1000) AND regexp_full_match(hostname, '[a-zA-Z0-9_\-./]*')"


def events_cte(lo: str = "2024-01-01", hi: str = "2024-02-01", where: str = "TRUE", name: str = "ev") -> str:
    return (
        f"{name} AS (SELECT * FROM rum WHERE {VALID} AND time >= TIMESTAMP '{lo}' AND time < TIMESTAMP '{hi}'"
        f" AND ({where}))"
    )


PV = """pv AS (SELECT id, max(time) AS time, CAST(max(weight) AS BIGINT) AS pageviews, max(lcp) AS lcp, max(cls) AS cls,
  max(fid) AS fid, max(inp) AS inp, max(ttfb) AS ttfb, min(hostname) AS hostname, min(host) AS host, min(url) AS url,
  min(referer) AS referer, min(user_agent) AS user_agent FROM ev GROUP BY id)"""
CP = """cp AS (SELECT id, checkpoint, target, source, max(time) AS time, CAST(max(weight) AS BIGINT) AS pageviews,
  min(hostname) AS hostname, min(host) AS host, min(url) AS url, min(referer) AS referer, min(user_agent) AS user_agent
  FROM ev GROUP BY id, checkpoint, target, source)"""


def add(name: str, select: str, *ctes: str, ev: str | None = None) -> None:
    parts = [sql_views(), ev or events_cte(), PV, CP, *ctes]
    ORACLES[name] = "WITH " + ",\n".join(parts) + "\n" + select


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def half_up(expression: str) -> str:
    return f"CAST(round({expression}) AS BIGINT)"


def ratio(over: str, under: str) -> str:
    return f"(CAST({over} AS DOUBLE) / nullif(CAST({under} AS DOUBLE), 0))"


def phi(x: str) -> str:
    z = f"(({x}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z})))"
    tail = (
        f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592)"
        f" * {t} * exp(-{z} * {z})"
    )
    return f"(0.5 * (1.0 + (CASE WHEN {z} < 0 THEN -1 ELSE 1 END) * (1.0 - {tail})))"


# ---- scans, filters, roll-ups

_vitals6 = ", ".join(f"round({v}, 6) AS {v}" for v in VITALS)
add("scan_events_v5", f"""SELECT hostname, host, user_agent, strftime(time, {STAMP}) AS time, url, {_vitals6}, referer,
  id, source, target, CAST(weight AS BIGINT) AS weight, checkpoint FROM ev""")
add("scan_events_v3", f"""SELECT hostname, host, user_agent, strftime(time, {STAMP}) AS time, url, lcp, fid, inp,
  round(cls, 6) AS cls, referer, id, source, target, CAST(weight AS BIGINT) AS weight, checkpoint FROM rum
  WHERE user_agent LIKE 'mobile%' AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
add("scan_cluster_generation", f"""SELECT id, strftime(time, {STAMP}) AS time, url, generation FROM rum
  WHERE hostname = 'blog.example.com' AND generation = 'gen-1'
  AND time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01'""")
add("scan_by_key", """SELECT c.secret, c.wanted, e.hostname, count(*) AS n, count(DISTINCT e.id) AS ids
FROM (VALUES ('key-1', 'www.example.com'), ('key-1', 'shop.example.org'), ('key-0', 'www.example.com'), ('key-10', '-')) c(secret, wanted), ev e
WHERE (c.wanted = '-' OR e.hostname = c.wanted) AND EXISTS (SELECT 1 FROM keyrows k WHERE k.secret = c.secret
  AND (k.revoke_date IS NULL OR k.revoke_date > DATE '2024-02-01')
  AND (k.hostname_prefix = '' OR c.wanted = k.hostname_prefix OR c.wanted LIKE '%.' || k.hostname_prefix)
  AND (k.hostname_prefix = '' OR e.url LIKE 'https://' || k.hostname_prefix || '/%' OR e.url LIKE 'https://%.' || k.hostname_prefix || '/%'))
GROUP BY ALL""")
add("scan_by_key_of_many_sites", """SELECT hostname, count(*) AS n, count(DISTINCT id) AS ids FROM ev
WHERE hostname IN ('www.example.com', 'blog.example.com', 'shop.example.org') AND EXISTS (SELECT 1 FROM keyrows k
  WHERE k.hostname_prefix = ev.hostname AND (k.revoke_date IS NULL OR k.revoke_date > DATE '2024-02-01')) GROUP BY hostname""")
add("url_match_modes", """SELECT m AS mode, n FROM (
  SELECT '-' AS m, count(*) AS n FROM q
  UNION ALL SELECT 'www.example.com', count(*) FROM q WHERE hostname = 'www.example.com'
  UNION ALL SELECT 'www.example.com/p1', count(*) FROM q WHERE url LIKE 'https://www.example.com/p1%'
  UNION ALL SELECT 'www.example.com/p1$', count(*) FROM q WHERE url = 'https://www.example.com/p1'
  UNION ALL SELECT 'www.example.com/p1?', count(*) FROM q WHERE url = 'https://www.example.com/p1' OR url LIKE 'https://www.example.com/p1?%'
  UNION ALL SELECT 'localhost:3000', 0
  UNION ALL SELECT 'www.example.com, blog.example.com,', count(*) FROM q WHERE hostname IN ('www.example.com', 'blog.example.com'))""",
    "q AS (SELECT hostname, url || CASE WHEN weight = 10 THEN '?a=1' ELSE '' END AS url FROM ev)")
add("device_class", """SELECT 'all' AS device, count(*) AS n FROM ev
  UNION ALL SELECT 'nobot', count(*) FROM ev WHERE user_agent NOT LIKE 'bot%'
  UNION ALL SELECT 'fridge', 0
  UNION ALL SELECT split_part(user_agent, ':', 1), count(*) FROM ev GROUP BY 1
  UNION ALL SELECT 'raw ' || split_part(user_agent, ':', 1), count(*) FROM ev GROUP BY 1""")
_spans = {
    "last 7 days": ("2024-01-25", "2024-02-01"), "offset 10": ("2024-01-15", "2024-01-22"),
    "pacific": ("2024-01-19 08:00", "2024-01-26 08:00"), "no zone": ("2024-01-20", "2024-01-27"),
    "dates": ("2024-01-05", "2024-01-07"), "dates in tokyo": ("2024-01-04 15:00", "2024-01-06 15:00"),
    "cut at now": ("2024-01-05", "2024-01-10 12:00"), "before": ("2024-01-18", "2024-01-25"),
}
add("time_range_bounds", " UNION ALL ".join(
    f"SELECT '{n}' AS span, count(*) AS n FROM rum WHERE time >= CAST('{lo}' AS TIMESTAMP) AND time < CAST('{hi}' AS TIMESTAMP)"
    for n, (lo, hi) in _spans.items()
) + """ UNION ALL SELECT 'closed dates', count(*) FROM rum
  WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'""")
add("prefix_list_exists", """SELECT source, count(*) AS n FROM ev
  WHERE EXISTS (SELECT 1 FROM (VALUES ('src1'), ('src3'), ('.fo')) p(prefix) WHERE ev.source LIKE p.prefix || '%')
  GROUP BY source""")
add("host_exclusions", r"""SELECT name,
  count(*) FILTER (WHERE (ok AND name NOT LIKE '%.hlx.page' AND name NOT LIKE '%.hlx3.page' AND name NOT LIKE '%.hlx.live'
    AND name NOT LIKE '%.helix3.dev' AND name NOT LIKE '%.sharepoint.com' AND name NOT LIKE '%.google.com'
    AND name NOT LIKE '%.edison.pfizer' AND name NOT LIKE '%.web.pfizer') OR name = 'www.hlx.live') AS pivot,
  count(*) FILTER (WHERE ok AND name NOT LIKE '%.hlx.page' AND name NOT LIKE '%.hlx3.page' AND name NOT LIKE '%.hlx.live'
    AND name NOT LIKE '%.helix3.dev' AND name NOT LIKE '%.sharepoint.com' AND name NOT LIKE '%.aem.page'
    AND name NOT LIKE '%.aem.live') AS content,
  count(*) FILTER (WHERE NOT regexp_matches(name, '(\.hlx\.live|\.hlx\.page|\.aem\.live|\.aem\.page|\.pfizer)$')) AS golive
FROM (SELECT name, name <> '' AND NOT regexp_full_match(name, '\d+\.\d+\.\d+\.\d+') AND name NOT LIKE 'localhost%' AS ok
  FROM (SELECT hostname AS name FROM rum UNION ALL SELECT v FROM rum, (VALUES ('10.0.0.1'), ('localhost'),
    ('docs.google.com'), ('www.hlx.live'), ('x.hlx.page'), (''), ('a.aem.live')) k(v)))
GROUP BY name""")
_roll6 = ", ".join(f"round({v}, 6) AS {v}" for v in ("lcp", "cls", "fid", "inp", "ttfb"))
add("rollup_pageviews", f"""SELECT id, strftime(time, {STAMP}) AS time, pageviews, {_roll6}, hostname, host, url, referer,
  user_agent FROM pv""")
add("rollup_checkpoints", f"""SELECT id, checkpoint, target, source, strftime(time, {STAMP}) AS time, pageviews, hostname,
  host, url, referer, user_agent FROM cp""")
add("urls_from_list", """SELECT c_custkey, 'c' || c_custkey || '.example.com' AS url FROM customer
  UNION ALL SELECT c_custkey, 'www.c' || c_custkey || '.example.com' FROM customer""")

add("sql_functions", f"""SELECT hostname, user_agent, count(*) AS n, {big('sum(pageviews)')} AS views,
  round(CASE WHEN max(pageviews) = 1 THEN 0 ELSE 1.96 * max(pageviews) * sqrt(count(*)) END, 6) AS margin FROM pv
  WHERE hostname IN ('www.example.com', 'blog.example.com') AND user_agent NOT LIKE 'bot%' GROUP BY 1, 2
UNION ALL SELECT hostname, checkpoint, count(*), {big('sum(pageviews)')}, round({phi('count(*) / 100.0')}, 6) FROM phones GROUP BY 1, 2""",
    """phones AS (SELECT id, checkpoint, target, source, hostname, max(weight) AS pageviews FROM ev
      WHERE url LIKE 'https://shop.example.org/p1%' AND user_agent LIKE 'mobile%' GROUP BY ALL)""",
    ev=events_cte())

_older = "user_agent LIKE 'mobile%' AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"
_cluster = "hostname = 'blog.example.com' AND generation = 'gen-1' AND time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01'"


def _rolled(name: str, where: str, generation: str) -> str:
    """Events, page views and checkpoints of a scan by host."""
    rolls = {"events": "", "pageviews": "GROUP BY id", "checkpoints": "GROUP BY id, checkpoint, target, source"}
    return " UNION ALL ".join(
        f"SELECT '{name}{of}' AS of, hostname, generation, count(*) AS n, {big('sum(w)')} AS views FROM (SELECT "
        + ("hostname, weight AS w" if of == "events" else "min(hostname) AS hostname, max(weight) AS w")
        + f", {generation} AS generation FROM rum WHERE {where} {how}) GROUP BY ALL" for of, how in rolls.items()
    )


add("sql_older_scans", _rolled("", _older, "CAST(NULL AS VARCHAR)") + " UNION ALL " + _rolled("cluster ", _cluster, "'gen-1'"))
ORACLES["sql_events_by_key"] = ORACLES["scan_by_key"]
add("sql_rollups_by_key", " UNION ALL ".join(
    f"SELECT '{name}' AS of, hostname, count(*) AS n, {big('sum(w)')} AS views FROM (SELECT min(hostname) AS hostname, max(weight) AS w FROM {of} GROUP BY {keys}) GROUP BY hostname"
    for name, of, keys in (("rum_pageviews", "opened", "id"), ("rum_checkpoints", "opened", "id, checkpoint, target, source"),
                           ("rum_pageviews_v3", "older", "id"), ("rum_checkpoints_v3", "older", "id, checkpoint, target, source"))),
    """live AS (SELECT hostname_prefix AS p FROM keyrows WHERE secret = 'key-1' AND (revoke_date IS NULL OR revoke_date > DATE '2024-02-01')
      AND (hostname_prefix = '' OR 'www.example.com' = hostname_prefix OR 'www.example.com' LIKE '%.' || hostname_prefix))""",
    """opened AS (SELECT * FROM ev WHERE hostname = 'www.example.com' AND EXISTS (SELECT 1 FROM live
      WHERE p = '' OR url LIKE 'https://' || p || '/%' OR url LIKE 'https://%.' || p || '/%'))""",
    """older AS (SELECT * FROM rum WHERE hostname = 'www.example.com' AND time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01' AND EXISTS (
      SELECT 1 FROM live WHERE p = '' OR url LIKE 'https://' || p || '/%' OR url LIKE 'https://%.' || p || '/%'))""")
add("events_of_two_collectors", f"""SELECT hostname, count(*) AS n, {big('sum(weight)')} AS views, count(CASE WHEN weight = 100 THEN ttfb END) AS readings,
  count(lcp) AS lcps FROM ev WHERE time >= TIMESTAMP '2024-01-18' GROUP BY hostname""")
add("events_on_days", """SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS event_date, checkpoint, count(*) AS n FROM rum WHERE CAST(time AS DATE) IN (
    SELECT CAST(time AS DATE) FROM rum WHERE checkpoint = 'click' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) GROUP BY 1, 2""")

# ---- generated rows

_grids = {
    24: ("hour", "TIMESTAMP '2023-12-31 19:00:00'", "TIMESTAMP '2024-01-31 18:00:00'", "1 hour"),
    1: ("day", "TIMESTAMP '2023-12-31'", "TIMESTAMP '2024-01-31'", "1 day"),
    7: ("week", "TIMESTAMP '2023-12-25'", "TIMESTAMP '2024-01-29'", "7 days"),
    30: ("month", "TIMESTAMP '2023-12-01'", "TIMESTAMP '2024-01-01'", "1 month"),
    90: ("quarter", "TIMESTAMP '2023-10-01'", "TIMESTAMP '2024-01-01'", "3 months"),
    365: ("year", "TIMESTAMP '2023-01-01'", "TIMESTAMP '2024-01-01'", "1 year"),
}
add("slots_by_granularity", " UNION ALL ".join(
    f"""SELECT CAST({g} AS BIGINT) AS granularity,
      strftime(s.slot, {SECONDS}) || CASE WHEN s.slot BETWEEN TIMESTAMP '2023-03-12 03:00:00' AND TIMESTAMP '2023-11-05' THEN '-04' ELSE '-05' END AS slot,
      count(e.id) AS n
    FROM (SELECT unnest(generate_series({lo}, {hi}, INTERVAL {step})) AS slot) s
    LEFT JOIN ev e ON date_trunc('{unit}', e.time - INTERVAL 5 HOUR) = s.slot GROUP BY s.slot"""
    for g, (unit, lo, hi, step) in _grids.items()
))
_NAMED = """iv AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'early', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10'),
  (1, 'middle', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20'), (2, 'late', TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-01'))
  t(n, interval_name, interval_start, interval_end))"""
add("named_intervals", f"""SELECT n, interval_name, strftime(interval_start, {STAMP}) AS interval_start,
  strftime(interval_end, {STAMP}) AS interval_end,
  (SELECT count(*) FROM ev WHERE time >= interval_start AND time < interval_end) AS events FROM iv""", _NAMED)
add("range_join_intervals", """SELECT CASE WHEN time >= TIMESTAMP '2024-01-15' THEN 'fifteen' WHEN time >= TIMESTAMP '2024-01-05'
  THEN 'five' END AS interval_name, checkpoint, count(*) AS events FROM ev GROUP BY 1, 2""")

# ---- aggregates

add("weighted_vitals", "SELECT url, " + ", ".join(
    f"round({ratio(f'sum({v} * pageviews)', 'sum(pageviews)')}, 6) AS {v}" for v in VITALS) + " FROM pv GROUP BY url")


def share(vital: str, limit: float, op: str, alias: str) -> str:
    hits = f"count(*) FILTER (WHERE {vital} {op} {limit})"
    return f"{half_up('100 * ' + ratio(hits, f'count({vital})'))} AS {alias}"


_shares = ", ".join(share(v, GOOD[v], "<=", f"{v}good") + ", " + share(v, BAD[v], ">=", f"{v}bad") for v in VITALS)
add("good_bad_share", f"SELECT url, {_shares} FROM pv GROUP BY url")
add("p75_exact", """SELECT l_returnflag, l_linestatus, round(quantile_disc(l_extendedprice, 0.75), 6) AS p75
  FROM lineitem GROUP BY ALL""")
add("p75_sketch", "SELECT hostname, " + ", ".join(f"round(quantile_disc({v}, 0.75), 6) AS {v}" for v in VITALS)
    + " FROM pv GROUP BY hostname")
add("sketched_vitals", "SELECT hostname, count(*) AS n, TRUE AS quantile_holds, TRUE AS count_holds FROM ev WHERE lcp IS NOT NULL GROUP BY hostname")
add("top_value_count", """SELECT url, arg_max(source, row(n, source)) AS top_source FROM
  (SELECT url, source, count(*) AS n FROM ev WHERE source IS NOT NULL GROUP BY ALL) GROUP BY url""")
add("top_value_sum", """SELECT url, arg_max(source, row(n, source)) AS top_source FROM
  (SELECT url, source, sum(weight) AS n FROM ev WHERE source IS NOT NULL GROUP BY ALL) GROUP BY url""")
add("distinct_counts", """SELECT checkpoint, count(*) AS n, count(DISTINCT url) AS urls, count(DISTINCT user_agent) AS agents
  FROM ev GROUP BY checkpoint""")
add("estimated_views", f"""SELECT url, checkpoint, count(*) AS ids, {big('count(DISTINCT id) * max(pageviews)')} AS views,
  {big('sum(pageviews)')} AS actions FROM cp GROUP BY url, checkpoint""")
add("pivot_months", "SELECT o_orderpriority, " + ", ".join(
    f"count(*) FILTER (WHERE month(o_orderdate) = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
add("margin_of_error", f"""SELECT hostname, CAST(weight AS BIGINT) AS weight, count(*) AS n,
  {half_up('CASE WHEN weight = 1 THEN 0 ELSE 1.96 END * weight * sqrt(count(*))')} AS margin,
  {half_up('2.58 * weight * sqrt(count(*))')} AS wide FROM ev GROUP BY hostname, weight""")
add("normal_cdf", f"SELECT event_id, round({phi('(value - 100) / 40')}, 6) AS p FROM events")
add("stddev_and_corr", """SELECT hostname, round(stddev_samp(lcp), 6) AS sd, round(stddev_samp(lcp) / sqrt(count(lcp)), 6) AS se,
  round(corr(lcp, pageviews), 6) AS corr, CAST(NULL AS DOUBLE) AS flat FROM pv GROUP BY hostname""")
add("two_levels", """SELECT source, url, count(*) AS n, CAST(0 AS BIGINT) AS total FROM ev GROUP BY source, url
  UNION ALL SELECT source, NULL, count(*), 1 FROM ev GROUP BY source""")

# ---- content requests

DAILY = f"""per_id AS (SELECT id, hostname, date_trunc('day', time) AS day, weight, CAST(weight AS BIGINT) AS html,
    CAST(weight AS BIGINT) * count(*) FILTER (WHERE checkpoint = 'loadresource' AND source NOT LIKE '%.html') AS json,
    coalesce(bool_or(user_agent LIKE 'bot%'), FALSE) AS bot, coalesce(bool_or(checkpoint = '404'), FALSE) AS gone,
    coalesce(bool_or(url LIKE '%/manifest.json' OR url LIKE '%/libs/%'), FALSE) AS nopage,
    coalesce(bool_or(source LIKE '%/api/qraphql/%' OR source LIKE '%/libs/%' OR source LIKE '%/manifest.json%'), FALSE) AS noapi
  FROM site GROUP BY id, hostname, date_trunc('day', time), weight),
daily AS (SELECT hostname, day, weight,
    CASE WHEN bot OR gone OR nopage THEN 0 ELSE sum(html) END AS cr_pageviews,
    CASE WHEN bot OR noapi THEN 0 ELSE {half_up('sum(json) / 5.0')} END AS cr_apicalls,
    sum(html) AS html_requests, sum(json) AS json_requests, CASE WHEN gone THEN sum(html) ELSE 0 END AS error404_requests,
    count(DISTINCT id) AS n
  FROM per_id GROUP BY hostname, day, weight, bot, gone, nopage, noapi),
rates AS (SELECT hostname, date_trunc('month', day) AS start, arg_max(weight, row(n, weight)) AS rate FROM
    (SELECT hostname, day, weight, count(*) AS n FROM (SELECT hostname, date_trunc('month', day) AS day, weight FROM daily) GROUP BY ALL)
  GROUP BY 1, 2),
months AS (SELECT d.hostname, date_trunc('month', day) AS start, {big('sum(cr_pageviews)')} AS cr_pageviews,
    {big('sum(cr_apicalls)')} AS cr_apicalls, {big('sum(html_requests)')} AS html_requests,
    {big('sum(json_requests)')} AS json_requests, {big('sum(error404_requests)')} AS error404_requests,
    {half_up('any_value(CASE WHEN rate = 1 THEN 0 ELSE 1.96 END * rate) * sqrt(sum(n))')} AS cr_margin_of_error
  FROM daily d JOIN rates r ON r.hostname = d.hostname AND r.start = date_trunc('month', day) GROUP BY 1, 2),
years AS (SELECT hostname, date_trunc('year', start) AS start, {big('sum(cr_pageviews)')} AS cr_pageviews,
    {big('sum(cr_apicalls)')} AS cr_apicalls, {big('sum(html_requests)')} AS html_requests,
    {big('sum(json_requests)')} AS json_requests, {big('sum(error404_requests)')} AS error404_requests,
    {big('sum(cr_margin_of_error)')} AS cr_margin_of_error FROM months GROUP BY 1, 2)"""
add("rollup_chain", f"""SELECT hostname, strftime(start, {STAMP}) AS year, cr_margin_of_error, cr_pageviews, cr_apicalls,
  html_requests, json_requests, error404_requests FROM years""", "site AS (SELECT * FROM ev)", DAILY)
SITE = """site AS (SELECT * FROM ev WHERE hostname <> '' AND hostname NOT LIKE '%.hlx.live')"""
HOSTS = """hosts AS (SELECT hostname, arg_max(host, row(n, host)) AS top_host FROM
  (SELECT hostname, host, count(*) AS n FROM site GROUP BY ALL) GROUP BY 1)"""


def content(name: str, table: str, letter: str, month: str, where: str = "TRUE") -> None:
    add(name, f"""SELECT sha1(t.hostname || '-{letter}-' || epoch_us(start)) AS id, year(start) AS year, {month} AS month,
  t.hostname, top_host, cr_pageviews + cr_apicalls AS content_requests, cr_margin_of_error, cr_pageviews, cr_apicalls,
  html_requests, json_requests, error404_requests, strftime(start, {ISO}) AS time
FROM (SELECT *, row_number() OVER (ORDER BY hostname, start) AS place FROM {table}) t JOIN hosts ON hosts.hostname = t.hostname
WHERE {where}""", SITE, DAILY, HOSTS)


content("content_requests_month", "months", "m", "month(start)")
content("content_requests_year", "years", "y", "CAST(NULL AS BIGINT)")
content("content_requests_page2", "months", "m", "month(start)", "place = 2")

# ---- order

add("top_n_other", f"""SELECT CASE WHEN place <= 5 THEN url ELSE 'Other' END AS label, {big('sum(views)')} AS views, count(*) AS urls
FROM (SELECT url, sum(pageviews) AS views, row_number() OVER (ORDER BY sum(pageviews) DESC, url) AS place FROM pv GROUP BY url)
GROUP BY 1""")
add("global_row_number", "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) AS rownum FROM events")
add("ntile_lcp", """SELECT id, round(lcp, 6) AS lcp, ntile(7) OVER (ORDER BY lcp, id) AS tile FROM pv WHERE lcp IS NOT NULL""")
DAYS = """visits AS (SELECT id, regexp_replace(min(url), '\\?.*$', '') AS url, min(hostname) AS host, date_trunc('day', max(time)) AS day,
    max(lcp) AS lcp, max(cls) AS cls, max(fid) AS fid, max(inp) AS inp, CAST(bool_or(checkpoint = 'top') AS INT) AS top,
    CAST(bool_or(checkpoint = 'load') AS INT) AS load, CAST(bool_or(checkpoint = 'click') AS INT) AS click FROM ev GROUP BY id),
urldays AS (SELECT day, url, max(host) AS host, avg(lcp) AS lcp, avg(cls) AS cls, avg(fid) AS fid, avg(inp) AS inp,
    least(CASE WHEN sum(top) > 0 THEN sum(load) / sum(top) ELSE 0 END, 1) AS load,
    least(CASE WHEN sum(top) > 0 THEN sum(click) / sum(top) ELSE 0 END, 1) AS click FROM visits GROUP BY day, url),
stepped AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY url ORDER BY day), day) AS step FROM urldays),
chained AS (SELECT *, count(*) FILTER (WHERE step = 1) OVER (PARTITION BY url ORDER BY day) AS chain FROM stepped)"""
add("running_chain", f"""SELECT url, strftime(day, {STAMP}) AS day, step, chain, round(load, 6) AS load, round(click, 6) AS click
  FROM chained""", DAYS)
add("keyset_page", """SELECT id, o_totalprice, o_custkey, rownum FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id,
  round(o_totalprice, 6) AS o_totalprice, o_custkey,
  row_number() OVER (ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR)) AS rownum FROM orders) WHERE rownum BETWEEN 41 AND 65""")
add("full_outer_periods", f"""SELECT coalesce(a.url, b.url) AS url, coalesce(a.user_agent, b.user_agent) AS user_agent, now, before
FROM (SELECT url, user_agent, {big('sum(pageviews)')} AS now FROM pv WHERE time >= TIMESTAMP '2024-01-16' GROUP BY 1, 2) a
FULL JOIN (SELECT url, user_agent, {big('sum(pageviews)')} AS before FROM pv WHERE time < TIMESTAMP '2024-01-16' GROUP BY 1, 2) b
ON a.url = b.url AND a.user_agent = b.user_agent""")


def cuts(metric: str, table: str = "chained") -> str:
    points = ", ".join(f"quantile_disc({metric}, {q})" for q in ("0.0", "1/3.0", "2/3.0", "1.0"))
    return f"(SELECT [{points}] FROM (SELECT DISTINCT {metric} FROM {table} WHERE {metric} IS NOT NULL))"


NUMS = "nums AS (SELECT unnest([0, 1, 2, 3]) AS num)"
add("bucket_lookup", f"""SELECT url, strftime(day, {STAMP}) AS day,
  (SELECT CAST(max(num) AS BIGINT) FROM nums WHERE k.lcp_cuts[num + 1] <= c.lcp) AS lcp_rank,
  (SELECT CAST(min(num) AS BIGINT) FROM nums WHERE c.load >= k.load_cuts[4 - num]) AS load_rank
FROM chained c, (SELECT {cuts('lcp')} AS lcp_cuts, {cuts('load')} AS load_cuts) k""", DAYS, NUMS)

# ---- dashboard

MEASURES = [f"{v}good" for v in VITALS] + [f"{v}bad" for v in VITALS] + [f"avg{v}" for v in VITALS]


def dashboard(name: str, limit: int, where: str = "TRUE", url: str = "url", wanted: str = "TRUE", rising: bool = False,
              raw_url: str = "url") -> None:
    flags = ", ".join(
        [share(v, GOOD[v], "<=", f"{v}good") for v in VITALS] + [share(v, BAD[v], ">=", f"{v}bad") for v in VITALS]
    )
    p75 = ", ".join(
        f"round(quantile_disc({v}, 0.75), 3) AS avg{v}" if v == "cls" else f"{half_up(f'quantile_disc({v}, 0.75)')} AS avg{v}"
        for v in VITALS
    )

    def means(weight: str, whole: bool) -> str:
        made = []
        for m in MEASURES:
            mean = ratio(f"sum({m} * {weight})", f"sum({weight})")
            if m == "avgcls":
                mean = f"round({mean}, 3)"
            elif whole:
                mean = half_up(mean)
            made.append(f"{mean} AS {m}")
        return ", ".join(made)

    label = "url" if rising else f"CASE WHEN place <= {limit} THEN url ELSE 'Other' END"
    columns = ", ".join(f"n.{m}" for m in MEASURES) + ", " + ", ".join(f"o.{m} AS {m}_1" for m in MEASURES)
    keep = "TRUE" if rising else f"place <= {limit} OR url = 'Other'"
    ctes = [
        f"seen AS (SELECT *, {raw_url} AS page FROM ev)",
        f"""views AS (SELECT id, time >= TIMESTAMP '2024-01-16' AS cur, max(weight) AS weight, max(page) AS url,
          {', '.join(f'max({v}) AS {v}' for v in VITALS)} FROM seen WHERE {wanted} GROUP BY 1, 2)""",
        """totals AS (SELECT cur, sum(w) AS allviews FROM (SELECT id, time >= TIMESTAMP '2024-01-16' AS cur, max(weight) AS w
          FROM seen GROUP BY 1, 2) GROUP BY cur)""",
        f"by_weight AS (SELECT cur, {url} AS url, weight, count(*) AS events, {flags}, {p75} FROM views GROUP BY 1, 2, 3)",
        f"by_url AS (SELECT cur, url, sum(events * weight) AS pageviews, {means('weight', False)} FROM by_weight GROUP BY 1, 2)",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY cur ORDER BY pageviews DESC, url) AS place FROM by_url)""",
        f"""labelled AS (SELECT cur, {label} AS label, {big('sum(pageviews)')} AS pageviews, {means('pageviews', True)},
          round(100 * sum(pageviews) / any_value(allviews), 6) AS rumshare
          FROM placed JOIN totals USING (cur) GROUP BY 1, 2)""",
        f"""paired AS (SELECT coalesce(n.label, o.label) AS url, n.pageviews, o.pageviews AS pageviews_1,
          coalesce(n.pageviews, 0) - coalesce(o.pageviews, 0) AS pageviews_diff, {columns},
          n.rumshare, o.rumshare AS rumshare_1, o.label AS url_1,
          row_number() OVER (ORDER BY n.pageviews DESC NULLS LAST, o.pageviews DESC NULLS LAST, coalesce(n.label, o.label)) AS place
          FROM (FROM labelled WHERE cur) n FULL JOIN (FROM labelled WHERE NOT cur) o ON n.label = o.label)""",
    ]
    add(name, f"SELECT * EXCLUDE (place) FROM paired WHERE {keep}", *ctes, ev=events_cte("2023-12-31", "2024-02-01", where))


_HOST = "nullif(regexp_extract(url, 'https://([^/]+)/', 1), '')"
dashboard("dashboard", 10, url=_HOST)
dashboard("dashboard_url", 3, where="hostname = 'www.example.com' AND user_agent NOT LIKE 'bot%'")
dashboard("dashboard_rising", 10, url=_HOST, rising=True)
dashboard("dashboard_repo", 4, raw_url="url || '/'", wanted="page LIKE 'https://%site--acme.hlx%/'")

# ---- page views over time


def pageviews(name: str, unit: str, lo: str, hi: str, now: str, first: str, last: str, step: str, shift: int = 0,
              where: str = "TRUE") -> None:
    text = f"strftime(s.slot, {SECONDS}) || '+{shift:02d}'"

    def forecast(column: str, part: float) -> str:
        age = f"floor((epoch(TIMESTAMP '{now}') - epoch(slot - INTERVAL {shift} HOUR)) / 3600)"
        mean = f"avg({column}) OVER (ORDER BY slot ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
        value = half_up(f"{column} / greatest({age} / 576.0, 1) * CAST({part} AS DOUBLE) + {mean} * (1 - CAST({part} AS DOUBLE))")
        return f"CASE WHEN slot = max(slot) OVER () THEN {value} ELSE {column} END"

    ctes = [
        f"""one AS (SELECT id, max(weight) AS pageviews, min(url) AS url,
          min(date_trunc('{unit}', time + INTERVAL {shift} HOUR)) AS slot FROM ev GROUP BY id)""",
        f"series AS (SELECT slot, count(DISTINCT url) AS url, {big('sum(pageviews)')} AS pageviews FROM one GROUP BY slot)",
        f"""foreseen AS (SELECT *, {forecast('pageviews', 0.5)} AS pageviews_forecast, {forecast('url', 0.2)} AS url_forecast
          FROM series)""",
        f"""grid AS (SELECT unnest(generate_series(CAST('{first}' AS TIMESTAMP), CAST('{last}' AS TIMESTAMP), INTERVAL {step})) AS slot)""",
    ]
    counts = ", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in ("url", "pageviews", "pageviews_forecast", "url_forecast"))
    add(name, f"""SELECT year(s.slot) AS year, month(s.slot) AS month, day(s.slot) AS day, hour(s.slot) AS hour, {text} AS time,
  {counts} FROM grid s LEFT JOIN foreseen f ON f.slot = s.slot""", *ctes, ev=events_cte(lo, hi, where))


pageviews("pageviews_hour", "hour", "2024-01-01", "2024-02-01", "2024-02-01", "2024-01-01", "2024-01-31 23:00:00", "1 hour")
pageviews("pageviews_day", "day", "2024-01-01", "2024-02-01", "2024-02-01", "2024-01-01", "2024-01-31", "1 day")
pageviews("pageviews_week", "week", "2023-12-21", "2024-02-01", "2024-02-01", "2023-12-18", "2024-01-29", "7 days")
pageviews("pageviews_month", "month", "2023-11-03", "2024-02-01", "2024-02-01", "2023-11-01", "2024-01-01", "1 month")
pageviews("pageviews_quarter", "quarter", "2023-05-07", "2024-02-01", "2024-02-01", "2023-04-01", "2024-01-01", "3 months")
pageviews("pageviews_year", "year", "2022-02-01", "2024-02-01", "2024-02-01", "2022-01-01", "2024-01-01", "1 year")
pageviews("pageviews_filtered", "day", "2023-12-31 23:00:00", "2024-01-31 23:00:00", "2024-02-01", "2024-01-01", "2024-01-31",
          "1 day", 1, """checkpoint = 'click' AND (source LIKE 'src1%' OR source LIKE 'src2%')
          AND (target LIKE 'https://t1%' OR target LIKE 'https://t2%')""")

_PUBLIC = r"""hostname <> '' AND NOT regexp_matches(hostname, '(\.hlx\.page|\.hlx3\.page|\.hlx\.live|\.google\.com)$')"""
_labels = ["2023-Feb", "2023-Mar", "2023-Apr", "2023-May", "2023-Jun", "2023-Jul", "2023-Aug", "2023-Sep", "2023-Oct",
           "2023-Nov", "2023-Dec", "2024-Jan"]
_months = ", ".join(f"""CAST(sum(pageviews) FILTER (WHERE strftime(time, '%Y-%b') = '{m}') AS BIGINT) AS "{m}" """ for m in _labels)
add("pageviews_pivot", f"""SELECT regexp_replace(hostname, '^www\\.', '') AS hostname, {_months} FROM pv WHERE {_PUBLIC} GROUP BY 1
HAVING greatest(coalesce("2023-Nov", 0), coalesce("2023-Dec", 0), coalesce("2024-Jan", 0)) >= 1000""",
    ev=events_cte("2023-01-31", "2024-01-31"))
add("domain_list", f"""SELECT a.hostname, '' AS ims_org_id, strftime(first_visit, '%Y-%m-%d') AS first_visit,
  strftime(last_visit, '%Y-%m-%d') AS last_visit, current_month_visits, total_visits, program_id, environment_id
FROM (SELECT site, {big("sum(pageviews) FILTER (WHERE strftime(time, '%Y-%m') = '2024-01')")} AS current_month_visits,
    {big('sum(pageviews)')} AS total_visits, min(time) AS first_visit, max(time) AS last_visit, site AS hostname FROM named GROUP BY site) a
LEFT JOIN (SELECT DISTINCT site, CAST(regexp_extract(host, '^publish-p(\\d+)', 1) AS BIGINT) AS program_id,
    CAST(regexp_extract(host, '^publish-p\\d+-e(\\d+)', 1) AS BIGINT) AS environment_id FROM named
    WHERE regexp_matches(host, '^publish-p\\d+-e\\d+')) b ON a.site = b.site
WHERE CAST(last_visit AS DATE) > DATE '2023-12-02'""",
    f"named AS (SELECT *, regexp_replace(hostname, '^www\\.', '') AS site FROM pv WHERE {_PUBLIC})",
    ev=events_cte("2023-12-31", "2024-01-31"))
add("golive_hints", """SELECT CASE WHEN time >= TIMESTAMP '2024-01-30' AND hostname LIKE '%.example.%' THEN 'new.' || hostname ELSE hostname END AS hostname,
  strftime(min(time), '%Y-%m-%d') AS first_rum FROM ev
WHERE checkpoint = 'top' AND hostname NOT LIKE '%.hlx.live' GROUP BY 1
HAVING min(time) >= TIMESTAMP '2024-01-30' ORDER BY 1 LIMIT 30""", ev=events_cte("2023-12-31", "2024-01-31"))

# ---- popularity


def first_rows(order: str, limit: int = 30) -> str:
    return f" ORDER BY {order} LIMIT {limit}"


def source_ctes(where: str) -> str:
    return f"""s AS (SELECT source, id, checkpoint, max(url) AS url, max(pageviews) AS views, sum(pageviews) AS actions
  FROM cp WHERE source IS NOT NULL AND {where} GROUP BY source, id, checkpoint)"""


def top_of(value: str, source: str, keys: str) -> str:
    """Most frequent value per group as a table (keys…, top)."""
    return f"""(SELECT {keys}, arg_max({value}, row(n, {value})) AS top FROM
      (SELECT {keys}, {value}, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {keys})"""


add("sources_aggregated", f"""SELECT g.checkpoint, g.source, ids, pages, '' AS url, t.top AS topurl, views, actions,
  round({ratio('actions', 'views')}, 6) AS actions_per_view FROM
  (SELECT checkpoint, source, count(id) AS ids, count(DISTINCT url) AS pages, {big('sum(views)')} AS views,
    {big('sum(actions)')} AS actions FROM s GROUP BY 1, 2) g
  JOIN {top_of('url', 's', 'checkpoint, source')} t ON t.checkpoint = g.checkpoint AND t.source = g.source"""
    + first_rows("views DESC, g.checkpoint, g.source"), source_ctes("TRUE"))
add("sources_by_url", f"""SELECT checkpoint, source, count(id) AS ids, count(DISTINCT url) AS pages, url, '' AS topurl,
  {big('sum(views)')} AS views, {big('sum(actions)')} AS actions, round({ratio('sum(actions)', 'sum(views)')}, 6) AS actions_per_view
  FROM s GROUP BY checkpoint, source, url""" + first_rows("views DESC, checkpoint, source, url", 20),
    source_ctes("checkpoint = 'click'"))
add("sources_targets", f"""SELECT g.checkpoint, g.source, g.target, ids, pages, t.top AS topurl, user_agents, a.top AS top_user_agent,
  views, views AS actions FROM
  (SELECT checkpoint, source, target, count(id) AS ids, count(DISTINCT url) AS pages, count(DISTINCT user_agent) AS user_agents,
    {big('sum(pageviews)')} AS views FROM st GROUP BY 1, 2, 3) g
  JOIN {top_of('url', 'st', 'checkpoint, source, target')} t ON t.checkpoint = g.checkpoint AND t.source = g.source
    AND t.target IS NOT DISTINCT FROM g.target
  JOIN {top_of('user_agent', 'st', 'checkpoint, source, target')} a ON a.checkpoint = g.checkpoint AND a.source = g.source
    AND a.target IS NOT DISTINCT FROM g.target""" + first_rows("views DESC, g.checkpoint, g.source, g.target NULLS LAST"),
    "st AS (SELECT * FROM cp WHERE source IS NOT NULL)")


def targets(name: str, where: str, parts: str) -> None:
    add(name, f"""SELECT g.checkpoint, g.part AS target, ids, pages, t.top AS topurl, views FROM
  (SELECT checkpoint, part, count(id) AS ids, count(DISTINCT url) AS pages, {big('sum(views)')} AS views FROM parts GROUP BY 1, 2) g
  JOIN {top_of('url', 'parts', 'checkpoint, part')} t ON t.checkpoint = g.checkpoint AND t.part = g.part"""
        + first_rows("views DESC, g.checkpoint, g.part"),
        f"""tv AS (SELECT target, id, checkpoint, regexp_replace(max(url), '\\?.*$', '') AS url, max(pageviews) AS views
          FROM cp WHERE target IS NOT NULL AND {where} GROUP BY 1, 2, 3)""",
        f"parts AS (SELECT id, checkpoint, url, views, unnest({parts}) AS part FROM tv)")


targets("targets_split", "checkpoint = 'click'", "string_split(target, '; ')")
targets("targets_extract", "source = 'src1'", "regexp_extract_all(target, 't[0-9]')")
add("not_found", f"""SELECT url, arg_max(source, row(views, source)) FILTER (WHERE source IS NOT NULL) AS top_source,
  CAST(to_json(list_sort(list(source) FILTER (WHERE source IS NOT NULL))) AS VARCHAR) AS all_sources, count(source) AS source_count,
  {big('sum(views)')} AS views, CAST(0 AS BIGINT) AS part FROM
  (SELECT url, source, count(DISTINCT id) * max(pageviews) AS views FROM cp WHERE checkpoint = '404' GROUP BY 1, 2)
  GROUP BY url""" + first_rows("views DESC, url"))
add("checkpoint_urls", f"""SELECT count(id) AS ids, {big('count(DISTINCT id) * max(pageviews)')} AS views, {big('sum(pageviews)')} AS actions,
  url, checkpoint, source, round({ratio('sum(pageviews)', 'count(DISTINCT id) * max(pageviews)')}, 6) AS actions_per_view
  FROM cp GROUP BY url, checkpoint, source""" + first_rows("views DESC, url, checkpoint, source NULLS LAST"))

# ---- journeys

FUNNEL = f"""w AS (SELECT id, checkpoint, max(weight) AS weight FROM ev WHERE checkpoint IS NOT NULL GROUP BY 1, 2),
steps AS (SELECT checkpoint, count(DISTINCT id) AS events, {big('sum(weight)')} AS views FROM w GROUP BY 1
  UNION ALL SELECT 'any', count(*), {big('sum(weight)')} FROM (SELECT id, max(weight) AS weight FROM w GROUP BY id))"""
add("checkpoint_funnel", """SELECT checkpoint, events, views,
  round(100 - 100.0 * views / max(views) OVER (ORDER BY views DESC, checkpoint ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 1) AS percent_dropoff,
  round(100.0 * views / max(views) OVER (), 1) AS percent_total FROM steps""", FUNNEL, ev=events_cte(where="user_agent NOT LIKE 'bot%'"))
add("plot_points", "SELECT CAST(to_json({'x': checkpoint, 'y': views}) AS VARCHAR) AS point FROM steps", FUNNEL)
add("bounces", f"""SELECT greatest((SELECT coalesce({big('sum(pageviews)')}, 0) FROM sessions), (SELECT coalesce({big('sum(pageviews)')}, 0) FROM lasted)) AS pageviews,
  CASE WHEN v > 0 THEN v END AS visits, CASE WHEN ppv > 0 THEN round(ppv, 6) END AS pagespervisit,
  CASE WHEN rate > 0 THEN round(rate, 6) END AS bounce_rate, CASE WHEN dur > 0 THEN dur END AS pageview_duration,
  CASE WHEN ppv > 0 AND round(ppv * dur) > 0 THEN {half_up('ppv * dur')} END AS visit_duration
FROM (SELECT {half_up('sum(visits)')} AS v, avg(pagespervisit) AS ppv FROM sessions),
  (SELECT quantile_disc(duration, 0.5) AS dur FROM lasted),
  (SELECT {ratio('count(*) FILTER (WHERE id NOT IN (SELECT id FROM clicked))', 'count(*)')} AS rate
    FROM (SELECT DISTINCT id FROM cp WHERE checkpoint = 'enter'))""",
    """lasted AS (SELECT id, hostname, max(pageviews) AS pageviews, CAST(floor((epoch_us(max(time)) - epoch_us(min(time))) / 1000000) AS BIGINT) AS duration
      FROM cp GROUP BY 1, 2)""",
    "seen AS (SELECT id, hostname, CAST(source AS BIGINT) AS pages, max(pageviews) AS pageviews FROM cp WHERE checkpoint = 'pagesviewed' GROUP BY 1, 2, 3)",
    """sessions AS (SELECT hostname, sum(pageviews) AS pageviews, 2 * (avg(pages) - 1) AS pagespervisit,
      sum(pageviews) / nullif(2 * (avg(pages) - 1), 0) AS visits FROM seen GROUP BY 1)""",
    "clicked AS (SELECT id FROM cp WHERE checkpoint = 'click' AND target IS NOT NULL)")


def bundles(name: str, where: str) -> None:
    add(name, f"""SELECT id, url, strftime(start, {ISO}) AS time, CAST(weight AS BIGINT) AS weight, user_agent, events, rownum,
  CAST(0 AS BIGINT) AS part FROM heads WHERE {where}""",
        f"""named AS (SELECT *, CASE WHEN lcp IS NOT NULL THEN 'cwv-lcp' WHEN inp IS NOT NULL THEN 'cwv-inp' WHEN cls IS NOT NULL
          THEN 'cwv-cls' WHEN ttfb IS NOT NULL THEN 'cwv-ttfb' ELSE checkpoint END AS step, coalesce(lcp, inp, cls, ttfb) AS value FROM ev)""",
        f"""heads AS (SELECT id, url, min(time) AS start, min(weight) AS weight, min(user_agent) AS user_agent,
          CAST(to_json(list({{'time': strftime(time, {ISO}), 'checkpoint': step, 'source': source, 'target': target, 'value': value}}
            ORDER BY time, step, source NULLS FIRST, target NULLS FIRST, value NULLS FIRST)) AS VARCHAR) AS events,
          row_number() OVER (ORDER BY min(time), id, url) AS rownum FROM named GROUP BY id, url)""",
        ev=events_cte("2024-01-05", "2024-01-06"))


bundles("bundles", "rownum <= 1000")
bundles("bundles_page2", """rownum > (SELECT min(rownum) FROM heads WHERE id = (SELECT id FROM heads WHERE rownum = 20))
  AND rownum <= 20 + (SELECT min(rownum) FROM heads WHERE id = (SELECT id FROM heads WHERE rownum = 20))""")
_fv = ("lcp", "cls", "inp", "fid")


def form_vital(v: str, value: str) -> str:
    return f"round({value}, 3)" if v == "cls" else half_up(value)


add("forms", f"""SELECT v.url, v.views, {', '.join(f'c.avg{x}' for x in _fv)}, coalesce(s.actions, 0) AS submissions FROM
  (SELECT url, {big('sum(views)')} AS views FROM (SELECT url, source, count(DISTINCT id) * max(pageviews) AS views FROM cp
    WHERE checkpoint = 'viewblock' AND source IN ('.form', '.marketo') GROUP BY 1, 2) GROUP BY url) v
  LEFT JOIN (SELECT url, {big('sum(pageviews)')} AS actions FROM cp WHERE checkpoint = 'formsubmit'
    AND (source LIKE '%.form%' OR source LIKE '%mktoForm%' OR source LIKE '%.marketo%') GROUP BY url) s ON s.url = v.url
  LEFT JOIN (SELECT url, {', '.join(f"{form_vital(x, ratio(f'sum({x} * weight)', 'sum(weight)'))} AS avg{x}" for x in _fv)} FROM
    (SELECT url, weight, {', '.join(f"{form_vital(x, f'quantile_disc({x}, 0.75)')} AS {x}" for x in _fv)} FROM
      (SELECT id, max(url) AS url, max(weight) AS weight, {', '.join(f'max({x}) AS {x}' for x in _fv)} FROM ev GROUP BY id)
      GROUP BY url, weight) GROUP BY url) c ON c.url = v.url""" + first_rows("v.views DESC, v.url"))

# ---- statistics


def experiments(name: str, trial: str, converting: str, threshold: int) -> None:
    ctes = [
        f"trials AS (SELECT source AS experiment, target AS variant, id, url, time, pageviews FROM cp WHERE checkpoint = 'experiment' AND {trial})",
        f"hits AS (SELECT id, max(pageviews) AS pageviews FROM cp WHERE checkpoint = 'click' AND {converting} GROUP BY id)",
        """won AS (SELECT experiment, variant, count(*) AS hit_events, CAST(sum(pageviews) AS BIGINT) AS hits FROM
          (SELECT t.experiment, t.variant, h.pageviews, row_number() OVER (PARTITION BY t.id ORDER BY t.experiment, t.variant) AS r
           FROM trials t JOIN hits h ON h.id = t.id) WHERE r = 1 GROUP BY 1, 2)""",
        """rates AS (SELECT t.experiment, t.variant, t.events, t.views, t.topurl, t.t95, t.t5, t.tdiff, w.hit_events, w.hits, w.hits / t.views AS rate FROM
          (SELECT experiment, variant, count(DISTINCT id) AS events, CAST(sum(pageviews) AS BIGINT) AS views, min(url) AS topurl, max(time) AS t95,
             min(time) AS t5, CAST(floor((epoch_us(max(time)) - epoch_us(min(time))) / 86400000000) AS BIGINT) AS tdiff FROM trials GROUP BY 1, 2) t
          FULL JOIN won w ON w.experiment = t.experiment AND w.variant = t.variant)""",
        """controls AS (SELECT e.experiment, coalesce(events, 0) AS events, coalesce(hit_events, 0) AS hit_events, coalesce(views, 0) AS views,
          coalesce(hits, 0) AS hits, coalesce(rate, 0) AS rate FROM (SELECT DISTINCT experiment FROM rates) e
          LEFT JOIN rates r ON r.experiment = e.experiment AND r.variant = 'control')""",
        f"""tested AS (SELECT *, sqrt(p * (1 - p * (1 / nullif(views, 0) + 1 / nullif(c_views, 0)))) AS se FROM
          (SELECT l.*, c.events AS c_events, c.hit_events AS c_hit_events, c.views AS c_views, c.hits AS c_hits, c.rate AS c_rate,
            {ratio('l.hit_events + c.hit_events', 'l.events + c.events')} AS p
          FROM rates l JOIN controls c ON c.experiment = l.experiment WHERE l.variant <> 'control'))""",
    ]
    add(name, f"""SELECT experiment, variant, tdiff, events AS variant_experimentation_events, c_events AS control_experimentation_events,
  hit_events AS variant_conversion_events, c_hit_events AS control_conversion_events, views AS variant_experimentations,
  c_views AS control_experimentations, hits AS variant_conversions, c_hits AS control_conversions,
  round(rate, 6) AS variant_conversion_rate, round(c_rate, 6) AS control_conversion_rate, topurl,
  strftime(t95, {SECONDS}) || '+00' AS time95, strftime(t5, {SECONDS}) || '+00' AS time5,
  round(p, 6) AS pooled_sample_proportion, round(se, 6) AS pooled_standard_error,
  round(sqrt(p * (1 - p) * (1 / nullif(views, 0) + 1 / nullif(c_views, 0))), 6) AS pooled_standard_error_std, round((rate - c_rate) / se, 6) AS test,
  round({phi('-abs((rate - c_rate) / se)')}, 6) AS p_value,
  {half_up(f'max(tdiff) OVER e * {threshold} / (c_hit_events + sum(hit_events) OVER e) - max(tdiff) OVER e')} AS remaining_runtime
FROM tested WINDOW e AS (PARTITION BY experiment)""", *ctes)


experiments("experiments", "TRUE", "TRUE", 500)
experiments("experiments_filtered", "source = 'exp-1'",
            "source LIKE 'src%' AND (target LIKE 'https://t1%' OR target LIKE 'https://t2%' OR target LIKE 'https://t3%')", 900)
add("intervals", f"""SELECT a.interval_name, a.events, a.conversions, round(a.rate, 6) AS conversion_rate, round(a.lcp_mean, 6) AS lcp_mean,
  a.lcp_count, round(a.sd, 6) AS lcp_stddev, strftime(a.interval_start, {SECONDS}) || '+00' AS interval_start,
  strftime(a.interval_end, {SECONDS}) || '+00' AS interval_end,
  CASE WHEN a.n <> z.n THEN round(1 - {phi('abs(a.rate - z.rate) / sqrt(((a.conversions + z.conversions) / (a.events + z.events)) * (1 - ((a.conversions + z.conversions) / (a.events + z.events)) * (1 / a.events + 1 / z.events)))')}, 6) END AS conversion_p_value,
  CASE WHEN a.n <> z.n THEN round(1 - {phi('abs(a.lcp_mean - z.lcp_mean) / (sqrt((a.lcp_count - 1) * a.se * a.se + (z.lcp_count - 1) * z.se * z.se) / sqrt(a.lcp_count + z.lcp_count - 2))')}, 6) END AS lcp_p_value
FROM per a JOIN (SELECT * FROM per ORDER BY n DESC LIMIT 1) z ON TRUE""", _NAMED,
    """ids AS (SELECT id, min(iv.n) AS n FROM ev JOIN iv ON time >= interval_start AND time < interval_end GROUP BY id)""",
    """clicks AS (SELECT id, count(DISTINCT target) AS clicks FROM ev WHERE checkpoint = 'click'
      AND (target LIKE 'https://%' OR target LIKE 'http://%') GROUP BY id)""",
    "speeds AS (SELECT id, min(lcp) AS lcp FROM ev WHERE lcp IS NOT NULL GROUP BY id)",
    f"""per AS (SELECT iv.n, interval_name, interval_start, interval_end, events, conversions, conversions / events AS rate, lcp_mean, lcp_count, sd,
      sd / sqrt(lcp_count) AS se FROM iv JOIN (SELECT n, count(*) AS events, {big('sum(coalesce(clicks, 0))')} AS conversions,
      avg(lcp) AS lcp_mean, count(lcp) AS lcp_count, stddev_samp(lcp) AS sd
      FROM ids LEFT JOIN clicks ON clicks.id = ids.id LEFT JOIN speeds ON speeds.id = ids.id GROUP BY n) g ON g.n = iv.n)""")
add("vitals_correlation", """SELECT tile AS lcp_percentile, round(lcp, 6) AS lcp, round(rate, 6) AS click_rate,
  round((SELECT corr(lcp, rate) FROM tiles), 6) AS correlation,
  round((SELECT corr(lcp, rate) FROM tiles WHERE lcp <= 2500 AND tile > 1), 6) AS good_correlation,
  round((SELECT boost FROM gain), 6) AS click_rate_boost, round((SELECT diff FROM gain), 6) AS lcp_diff FROM tiles""",
    """speeds AS (SELECT id, min(lcp) AS lcp,
      CASE WHEN bool_or(checkpoint = 'click' AND target IS NOT NULL) THEN 1 ELSE 0 END AS clicks FROM ev GROUP BY id HAVING min(lcp) IS NOT NULL)""",
    """tiles AS (SELECT tile, avg(lcp) AS lcp, avg(clicks) AS rate FROM (SELECT *, ntile(10) OVER (ORDER BY lcp, id) AS tile FROM speeds)
      GROUP BY tile)""",
    """gain AS (SELECT (b.rate - t.rate) / nullif(t.rate, 0) AS boost, t.lcp - b.lcp AS diff FROM tiles t,
      (SELECT * FROM tiles WHERE rate = (SELECT max(rate) FROM tiles)) b WHERE t.lcp - b.lcp < 1000 ORDER BY t.lcp DESC, b.lcp LIMIT 1)""")


def mark(score: str) -> str:
    return f"CASE WHEN {score} <= 1 THEN 'A' WHEN {score} <= 2 THEN 'B' WHEN {score} <= 3 THEN 'C' WHEN {score} <= 4 THEN 'D' ELSE 'F' END"


_low, _high = ("cls", "lcp", "fid"), ("load", "click", "reach", "persistence")
_ranks = ", ".join(
    [f"(SELECT max(num) FROM nums WHERE k.{m}_cuts[num + 1] <= h.{m}) AS {m}_rank" for m in _low]
    + [f"(SELECT min(num) FROM nums WHERE h.{m} >= k.{m}_cuts[4 - num]) AS {m}_rank" for m in _high]
)
_speed, _aud = "((cls_rank + lcp_rank + fid_rank) / 3)", "((reach_rank + persistence_rank + load_rank) / 3)"
add("experience_score", f"""SELECT host, {mark(f'(({_speed} + {_aud} + click_rank) / 3)')} AS experiencescore, {mark(_speed)} AS perfscore,
  {mark(_aud)} AS audiencescore, {mark('click_rank')} AS engagementscore FROM
  (SELECT host, {_ranks} FROM hosts h, (SELECT {', '.join(f'{cuts(m)} AS {m}_cuts' for m in _low + _high[:2])},
    {', '.join(f"{cuts(m, 'powered')} AS {m}_cuts" for m in _high[2:])}) k WHERE host NOT LIKE '%.hlx.%')
  WHERE {' AND '.join(f'{m}_rank IS NOT NULL' for m in _low + _high)}""", DAYS, NUMS,
    """hosts AS (SELECT host, avg(cls) AS cls, avg(lcp) AS lcp, avg(fid) AS fid, avg(load) AS load, avg(click) AS click,
      count(*) FILTER (WHERE chain = 1) AS reach, count(*) FILTER (WHERE chain = 7) AS persistence FROM chained GROUP BY host)""",
    "powered AS (SELECT * FROM hosts WHERE reach > 0 AND persistence > 0)")

# ---- request log

add("dev_urls", """SELECT req_http_x_owner, req_http_x_repo, req_http_x_ref, req_url, count(*) AS requests FROM reqs
WHERE month = '202401' AND req_http_x_owner = 'acme' AND req_http_x_repo = 'site' AND req_http_x_ref = 'main' AND status_code = '200'
  AND resp_http_content_type LIKE 'text/html%' AND req_http_x_url NOT LIKE '%.plain.html%' AND req_url NOT LIKE '%/head.html%'
GROUP BY 1, 2, 3, 4""" + first_rows("requests DESC, req_url", 5))
add("guess_hostname", """SELECT req_http_x_owner AS owner, req_http_x_repo AS repo, req_http_x_ref AS ref, count(*) AS requests,
  regexp_extract(req_http_referer, 'https://([^/]+)', 1) AS host FROM reqs
WHERE month BETWEEN '202401' AND '202402' AND regexp_matches(req_http_referer, 'https://[^/]+/.*') AND req_http_x_ref = 'main'
  AND CAST(time_start_usec AS BIGINT) > epoch_us(TIMESTAMP '2024-01-01') AND CAST(time_start_usec AS BIGINT) < epoch_us(TIMESTAMP '2024-02-01')
GROUP BY 1, 2, 3, 5""" + first_rows("requests DESC, owner, repo, ref, host"))

# ---- keys and table jobs

add("key_privileges", """SELECT s.secret, coalesce(bool_or(hostname_prefix = ''), FALSE) AS read,
  coalesce(bool_or(hostname_prefix = '' AND NOT readonly), FALSE) AS write
FROM (VALUES ('key-0'), ('key-1'), ('key-10'), ('unknown')) s(secret) LEFT JOIN keyrows k ON k.secret = s.secret
  AND (revoke_date IS NULL OR revoke_date > DATE '2024-02-01') GROUP BY s.secret""")
add("rotate_keys", """SELECT hostname_prefix, CAST(revoke_date AS VARCHAR) AS revoke_date, readonly, CAST(create_date AS VARCHAR) AS create_date,
  note, is_new, count(*) AS n FROM
  (SELECT hostname_prefix, CASE WHEN hostname_prefix IN ('example.com', 'shop.example.org')
      AND (revoke_date IS NULL OR revoke_date > DATE '2024-02-01') THEN DATE '2024-02-06' ELSE revoke_date END AS revoke_date,
    readonly, create_date, note, FALSE AS is_new FROM keyrows
  UNION ALL SELECT h, DATE '2025-01-01', TRUE, DATE '2024-02-01', 'rotated', TRUE FROM (VALUES ('example.com'), ('shop.example.org')) v(h))
GROUP BY ALL""")
add("revoke_key", """SELECT hostname_prefix, CAST(CASE WHEN secret = 'key-1' AND hostname_prefix = 'example.com' THEN DATE '2024-02-04'
  ELSE revoke_date END AS VARCHAR) AS revoke_date, count(*) AS n FROM keyrows GROUP BY 1, 2""")
add("upsert_domain_info", """SELECT coalesce(c.domain, d.domain) AS domain, coalesce(c.ims_org_id, d.ims_org_id) AS ims_org_id
FROM doms d FULL JOIN domchanges c ON c.domain = d.domain""")
add("add_audit_scores", """SELECT 'Lighthouse Data Successfully Uploaded' AS status, url, device_type, time, audit_ref,
  count(*) AS number_of_row_instances FROM auds GROUP BY url, device_type, time, audit_ref""")

ORACLES["sql_key_privileges"] = ORACLES["key_privileges"]

ORACLES["bundles_page2_by_position"] = ORACLES["bundles_page2"]
ORACLES["content_requests_page2_by_position"] = ORACLES["content_requests_page2"]

# ---- results

add("nested_rows", """SELECT page_id, page_id % 2 = 0 AS is_admin,
  CAST(to_json(['{"event": "page_view", "url": "' || url || '"}', url]) AS VARCHAR) AS events,
  CAST(to_json({'foo': 'foo', 'bar': page_id % 10}) AS VARCHAR) AS metadata,
  CAST(to_json([{'foo': 'foo', 'bar': page_id % 10}, {'foo': 'foo', 'bar': page_id}]) AS VARCHAR) AS meta_array FROM pages""")
add("csv_export", """SELECT event_id || ',"' || replace(props, '"', '""') || '",' || CASE WHEN user_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END
  || ',"' || event_type || '",' || CASE user_id % 4 WHEN 0 THEN CAST(user_id // 4 AS VARCHAR) ELSE CAST(user_id / 4 AS VARCHAR) END AS line
FROM events""")
add("sheet_export", """SELECT CAST(to_json({'page_id': page_id, 'url': url, 'rest': nullif(page_id % 3, 0)}) AS VARCHAR) AS row FROM pages""")
add("size_cap", """SELECT o_orderkey, o_custkey, o_orderstatus,
  CAST(floor((sum(size) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - size) / 40000) AS BIGINT) AS part
FROM (SELECT o_orderkey, o_custkey, o_orderstatus,
  length(CAST(to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus}) AS VARCHAR)) AS size FROM orders)""")
