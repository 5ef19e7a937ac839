"""The scans, their roll-ups, access keys and the scalar functions for users of SQL, as temporary SQL functions.

Spark inlines their bodies, so literal arguments fold and filters reach the file scan:

    SELECT hostname, sum(pageviews) FROM rum_pageviews('www.example.com', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', 'all')
    GROUP BY hostname

With a view of keys there is a `_keyed` form of each function that may need one; it takes a secret and the day on which keys
must be live, and gives what that secret opens, by a semi-join on the hosts that occur.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from pagetally.functions import fixed_values as fixed

A1, A2, A3, A4, A5 = (f"{a}D" for a in fixed.ERF_A)
T = f"(1 / (1 + {fixed.ERF_P}D * abs(x / sqrt(2.0D))))"

SCALARS = {
    "device_matches(agent STRING, device STRING) RETURNS BOOLEAN": """
        CASE device WHEN 'all' THEN true WHEN 'nobot' THEN NOT startswith(agent, 'bot')
        WHEN 'desktop' THEN startswith(agent, 'desktop') WHEN 'mobile' THEN startswith(agent, 'mobile')
        WHEN 'bot' THEN startswith(agent, 'bot') ELSE false END""",
    "clean_timezone(zone STRING) RETURNS STRING": "CASE WHEN zone IN ('', 'undefined') THEN 'GMT' ELSE zone END",
    "url_matches(page STRING, wanted STRING) RETURNS BOOLEAN": """
        wanted = '-' OR exists(
            CASE WHEN startswith(wanted, 'localhost') THEN array('https://', 'http://') ELSE array('https://') END,
            scheme -> CASE
                WHEN endswith(wanted, '$') THEN page = concat(scheme, left(wanted, length(wanted) - 1))
                WHEN endswith(wanted, '?')
                    THEN page = concat(scheme, left(wanted, length(wanted) - 1)) OR startswith(page, concat(scheme, wanted))
                ELSE startswith(page, concat(scheme, wanted)) END)""",
    "margin_of_error(rate DOUBLE, successes DOUBLE) RETURNS DOUBLE":
        f"CASE WHEN rate = 1 THEN 0D ELSE {fixed.Z_95}D END * rate * sqrt(successes)",
    "normal_cdf(x DOUBLE) RETURNS DOUBLE": f"""
        0.5D * (1 + CASE WHEN x < 0 THEN -1 ELSE 1 END * (1 -
        (((({A5} * {T} + {A4}) * {T} + {A3}) * {T} + {A2}) * {T} + {A1}) * {T} * exp(-x * x / 2)))""",
    "score_letter(score DOUBLE) RETURNS STRING": """
        CASE WHEN score <= 1 THEN 'A' WHEN score <= 2 THEN 'B' WHEN score <= 3 THEN 'C' WHEN score <= 4 THEN 'D' ELSE 'F' END""",
}

SCALARS |= {
    "url_host(page STRING) RETURNS STRING":
        "CASE WHEN startswith(page, 'https://') AND locate('/', page, 9) > 9 THEN substring(page, 9, locate('/', page, 9) - 9) END",
    # the global prefix, the host and its parent domains
    "host_prefixes(host STRING) RETURNS ARRAY<STRING>": """
        CASE WHEN host IS NULL THEN array('') ELSE concat(array(''), transform(sequence(1, size(split(host, '[.]'))),
            i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))) END""",
    "key_covers(prefix STRING, wanted STRING) RETURNS BOOLEAN": """
        prefix = '' OR prefix = wanted OR startswith(wanted, concat(prefix, '/'))
        OR endswith(split_part(wanted, '/', 1), concat('.', prefix)) OR array_contains(split(replace(rtrim(',', wanted), ' ', ''), ','), prefix)""",
}

EVENT_COLUMNS = (
    "hostname STRING, host STRING, user_agent STRING, time TIMESTAMP, url STRING, lcp DOUBLE, fid DOUBLE, inp DOUBLE,"
    " cls DOUBLE, ttfb DOUBLE, referer STRING, id STRING, source STRING, target STRING, weight INT, checkpoint STRING"
)
RANGE = "wanted STRING, since TIMESTAMP, before TIMESTAMP, device STRING"
KEY = "secret STRING, today DATE"


def _names(columns: str) -> str:
    return ", ".join(column.split()[0] for column in columns.split(", "))


def _tables(view: str, keys_view: str | None) -> dict[str, str]:
    weights = ", ".join(map(str, fixed.VALID_WEIGHTS))
    hostname = fixed.VALID_HOSTNAME.replace("\\", "\\\\")
    texts = ("hostname", "host", "url", "referer", "user_agent")
    page = """((url_matches(url, wanted) AND (wanted = '-' OR hostname = split_part(rtrim('$?', wanted), '/', 1)
          OR (startswith(wanted, 'localhost:') AND hostname = 'localhost')))
      OR array_contains(split(replace(rtrim(',', wanted), ' ', ''), ','), hostname))"""
    without_ttfb = EVENT_COLUMNS.replace(" ttfb DOUBLE,", "")
    cluster_columns = f"{EVENT_COLUMNS}, generation STRING"
    made = {
        "urls_from_list(list STRING) RETURNS TABLE (url STRING)":
            "SELECT explode(split(replace(rtrim(',', list), ' ', ''), ','))",
        f"rum_events({RANGE}) RETURNS TABLE ({EVENT_COLUMNS})": f"""
            SELECT {_names(EVENT_COLUMNS)} FROM {view} WHERE time >= since AND time < before AND device_matches(user_agent, device)
            AND weight IN ({weights}) AND coalesce(rlike(hostname, '{hostname}'), false) AND {page}""",
        # the older scans: a closed upper bound and no filters of quality
        f"rum_events_v3({RANGE}) RETURNS TABLE ({without_ttfb})": f"""
            SELECT {_names(without_ttfb)} FROM {view} WHERE time >= since AND time <= before AND device_matches(user_agent, device) AND {page}""",
        f"cluster_events({RANGE}, code STRING) RETURNS TABLE ({cluster_columns})": f"""
            SELECT {_names(cluster_columns)} FROM {view} WHERE time >= since AND time <= before AND device_matches(user_agent, device) AND {page}
            AND (code = '-' OR generation = code)""",
    }
    scans = [
        ("rum_events", "rum_", "", EVENT_COLUMNS, RANGE, True), ("rum_events_v3", "rum_", "_v3", without_ttfb, RANGE, True),
        ("cluster_events", "cluster_", "", cluster_columns, f"{RANGE}, code STRING", False),
    ]
    for scan, before, after, columns, arguments, has_keys in scans:
        forms = [("", scan, arguments)]
        if has_keys and keys_view:
            given = _names(arguments)
            made[f"{scan}_keyed({arguments}, {KEY}) RETURNS TABLE ({columns})"] = f"""
                SELECT {_names(columns)} FROM (SELECT *, url_host(url) AS page_host FROM {scan}({given})) e LEFT SEMI JOIN (
                    SELECT DISTINCT host AS open_host FROM (
                        SELECT host, explode(prefixes) AS prefix FROM (
                            SELECT host, host_prefixes(host) AS prefixes FROM (SELECT DISTINCT url_host(url) AS host FROM {scan}({given}))
                        )
                    ) JOIN (
                        SELECT DISTINCT hostname_prefix FROM {keys_view} WHERE key_bytes = sha2(secret, 512) AND (revoke_date IS NULL OR revoke_date > today)
                        AND key_covers(hostname_prefix, wanted)
                    ) ON prefix = hostname_prefix
                ) ON page_host <=> open_host"""
            forms.append(("_keyed", f"{scan}_keyed", f"{arguments}, {KEY}"))
        kinds = {c.split()[0]: c for c in columns.split(", ")}
        vitals = [v for v in ("lcp", "fid", "inp", "cls", "ttfb") if v in kinds]
        own = [*texts, *(["generation"] if "generation" in kinds else [])]
        for suffix, source, taken in forms:
            of = f"{source}({_names(taken)})"
            picked = ", ".join(f"min({c}) AS {c}" for c in own)
            typed = ", ".join(kinds[c] for c in own)
            made[f"{before}pageviews{after}{suffix}({taken}) RETURNS TABLE (id STRING, time TIMESTAMP, pageviews INT, {', '.join(kinds[v] for v in vitals)}, {typed})"] = f"""
                SELECT id, max(time), max(weight), {', '.join(f'max({v}) AS {v}' for v in vitals)}, {picked} FROM {of} GROUP BY id"""
            made[f"{before}checkpoints{after}{suffix}({taken}) RETURNS TABLE (id STRING, checkpoint STRING, target STRING, source STRING, time TIMESTAMP, pageviews INT, {typed})"] = f"""
                SELECT id, checkpoint, target, source, max(time), max(weight), {picked} FROM {of} GROUP BY id, checkpoint, target, source"""
    if keys_view:
        made[f"key_privileges({KEY}) RETURNS TABLE (read BOOLEAN, write BOOLEAN)"] = f"""
            SELECT coalesce(bool_or(hostname_prefix = ''), false), coalesce(bool_or(hostname_prefix = '' AND NOT readonly), false)
            FROM {keys_view} WHERE key_bytes = sha2(secret, 512) AND (revoke_date IS NULL OR revoke_date > today)"""
    return made


def register(spark: SparkSession, events_view: str, keys_view: str | None = None) -> None:
    """Define the functions in a session, over a view of raw events and, for those that take a secret, one of keys."""
    for head, body in {**SCALARS, **_tables(events_view, keys_view)}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
