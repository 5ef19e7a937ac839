"""Stand-ins: telemetry, request log, keys and audits as views over the supplied tables.

Texts with ``{table}`` marks run unchanged in Spark SQL and, with plain table names, in DuckDB.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.operators.access import key_digest
from pagetally.operators.materialise import shared_folder

# ts is stored without a zone; reading it as an instant keeps time filters in the file scan
EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

RUM = """
SELECT
  'u' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS id,
  CASE user_id % 4 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'blog.example.com' WHEN 2 THEN 'shop.example.org' ELSE 'main--site--acme.hlx.live' END AS hostname,
  CASE WHEN user_id % 4 = 2 THEN 'publish-p12-e34.cloud.example.net' ELSE 'rum.example.net' END AS host,
  CASE user_id % 5 WHEN 0 THEN 'desktop:windows' WHEN 1 THEN 'desktop:mac' WHEN 2 THEN 'mobile:ios' WHEN 3 THEN 'mobile:android' ELSE 'bot:search' END AS user_agent,
  ts AS time,
  'https://' || CASE user_id % 4 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'blog.example.com' WHEN 2 THEN 'shop.example.org' ELSE 'main--site--acme.hlx.live' END
    || '/p' || CAST((CAST(floor(user_id / 4) AS INT) + CAST(extract(day FROM ts) AS INT)) % 6 AS STRING) AS url,
  CASE WHEN event_type = 'view' AND k < 40 THEN CAST(round(value * 12) AS DOUBLE) END AS lcp,
  CASE WHEN event_type = 'view' AND k BETWEEN 20 AND 59 THEN CAST(k * 6 AS DOUBLE) END AS fid,
  CASE WHEN event_type = 'view' AND k BETWEEN 30 AND 69 THEN CAST(k * 8 AS DOUBLE) END AS inp,
  CASE WHEN event_type = 'view' AND k BETWEEN 40 AND 79 THEN CAST(k AS DOUBLE) / 256 END AS cls,
  CASE WHEN event_type = 'view' AND k >= 60 THEN CAST(k * 25 AS DOUBLE) END AS ttfb,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'https://ref' || CAST(k % 4 AS STRING) || '.example.com/' END AS referer,
  CASE event_type
    WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'enter' WHEN 1 THEN 'viewblock' WHEN 2 THEN 'top' ELSE 'load' END
    WHEN 'click' THEN 'click'
    WHEN 'signup' THEN CASE k % 2 WHEN 0 THEN 'formsubmit' ELSE 'pagesviewed' END
    WHEN 'purchase' THEN CASE k % 2 WHEN 0 THEN 'experiment' ELSE 'loadresource' END
    ELSE '404' END AS checkpoint,
  CASE
    WHEN event_type = 'view' AND k % 4 = 1 THEN CASE k % 3 WHEN 0 THEN '.form' WHEN 1 THEN '.marketo' ELSE '.hero' END
    WHEN event_type = 'signup' AND k % 2 = 0 THEN CASE k % 3 WHEN 0 THEN 'x.form' ELSE '#mktoForm_1' END
    WHEN event_type = 'signup' THEN CAST(1 + k % 5 AS STRING)
    WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'exp-' || CAST(user_id % 3 AS STRING)
    WHEN event_type = 'purchase' THEN CASE k % 3 WHEN 0 THEN '/a.html' WHEN 1 THEN '/q.json' ELSE '/libs/x.json' END
    WHEN k % 7 = 0 THEN NULL
    ELSE 'src' || CAST(k % 5 AS STRING) END AS source,
  CASE
    WHEN event_type = 'purchase' AND k % 2 = 0 THEN CASE user_id % 2 WHEN 0 THEN 'control' ELSE 'challenger-1' END
    WHEN event_type = 'click' AND k % 5 = 0 THEN NULL
    WHEN event_type = 'click' THEN 'https://t' || CAST(k % 6 AS STRING) || '.example.com/; tag' || CAST(k % 3 AS STRING)
    ELSE NULL END AS target,
  CASE CAST(floor(user_id / 6) AS INT) % 6 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 100 WHEN 4 THEN 1000 ELSE 7 END AS weight,
  CASE WHEN k % 4 = 0 THEN 'gen-1' ELSE 'gen-2' END AS generation
FROM (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) AS b
"""

REQUESTS = """
SELECT
  CASE page_id % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'globex' ELSE 'initech' END AS req_http_x_owner,
  CASE page_id % 2 WHEN 0 THEN 'site' ELSE 'blog' END AS req_http_x_repo,
  CASE WHEN page_id % 4 = 3 THEN 'dev' ELSE 'main' END AS req_http_x_ref,
  url AS req_http_referer,
  CASE page_id % 10 WHEN 0 THEN '/head.html' WHEN 1 THEN '/a.plain.html' ELSE '/p' || CAST(page_id % 7 AS STRING) END AS req_url,
  CASE page_id % 10 WHEN 1 THEN '/a.plain.html' ELSE '/p' || CAST(page_id % 7 AS STRING) END AS req_http_x_url,
  CASE WHEN page_id % 6 = 5 THEN 'application/json' ELSE 'text/html; charset=utf-8' END AS resp_http_content_type,
  CASE WHEN page_id % 8 = 7 THEN '404' ELSE '200' END AS status_code,
  CAST(1704067200000000 + page_id * 3600000000 AS STRING) AS time_start_usec,
  CASE WHEN page_id % 5 = 4 THEN '202312' ELSE '202401' END AS month
FROM {pages}
"""

# One key row per customer. Twenty secrets: key-0 and key-10 are global, key-1 to key-3 and key-11 to
# key-13 open one site (in many rows), the others one site per customer. key-0, 4, 8, 12, 16 are revoked.
KEYS = """
SELECT
  CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'example.com' WHEN 2 THEN 'shop.example.org' WHEN 3 THEN 'blog.example.com'
    ELSE 'c' || CAST(c_custkey AS STRING) || '.example.net' END AS hostname_prefix,
  'key-' || CAST(c_custkey % 20 AS STRING) AS secret,
  CASE c_custkey % 4 WHEN 0 THEN DATE '2024-01-20' WHEN 1 THEN DATE '2024-03-01' ELSE NULL END AS revoke_date,
  c_custkey % 3 <> 0 AS readonly,
  DATE '2023-06-01' AS create_date,
  'from table' AS note
FROM {customer}
"""

DOMAINS = """
SELECT 's' || CAST(s_suppkey AS STRING) || '.example.com' AS domain, 'org-' || CAST(s_nationkey AS STRING) AS ims_org_id
FROM {supplier}
"""

DOMAIN_CHANGES = """
SELECT DISTINCT 's' || CAST(p_partkey % 150 AS STRING) || '.example.com' AS domain,
  'new-' || CAST(p_partkey % 150 AS STRING) AS ims_org_id
FROM {part}
"""

AUDITS = """
SELECT url,
  CAST(page_id % 100 AS DOUBLE) / 100 AS perf_score, CAST(page_id % 90 AS DOUBLE) / 100 AS acc_score,
  CAST(page_id % 80 AS DOUBLE) / 100 AS bp_score, CAST(page_id % 70 AS DOUBLE) / 100 AS seo_score,
  -1.0e0 AS perf_tti_score, -1.0e0 AS perf_speed_idx, -1.0e0 AS seo_crawl_score, -1.0e0 AS seo_crawl_anchors_score,
  -1.0e0 AS net_servr_time, -1.0e0 AS net_nl, -1.0e0 AS net_mainthread_work_score, -1.0e0 AS net_total_blocking_score,
  -1.0e0 AS net_img_optimization_score, -1.0e0 AS third_party_score,
  CASE page_id % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
  '2024-01-' || CAST(10 + page_id % 15 AS STRING) AS time, 'audit-' || CAST(page_id % 3 AS STRING) AS audit_ref
FROM {pages}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.read.schema(EVENTS_SCHEMA) if name == "events" else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def rum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUM, events=table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS, pages=table(spark, sf_dir, "pages"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(KEYS, customer=table(spark, sf_dir, "customer"))
    return rows.select(
        "hostname_prefix", key_digest(F.col("secret")).alias("key_bytes"), "revoke_date", "readonly",
        "create_date", F.lit(None).cast("string").alias("parent_key_bytes"), "note",
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOMAINS, supplier=table(spark, sf_dir, "supplier"))


def domain_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOMAIN_CHANGES, part=table(spark, sf_dir, "part"))


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(AUDITS, pages=table(spark, sf_dir, "pages"))


def scratch(spark: SparkSession) -> str:
    """A new folder for a job's tables, below the folder that the cluster shares."""
    return f"{shared_folder(spark)}/job-{uuid.uuid4()}"


def sql_views() -> str:
    """The stand-ins as DuckDB common table expressions, without the leading WITH."""
    texts = {"rum": RUM, "reqs": REQUESTS, "keyrows": KEYS, "doms": DOMAINS, "domchanges": DOMAIN_CHANGES, "auds": AUDITS}
    return ",\n".join(
        f"{name} AS ({text.strip().replace('{', '').replace('}', '')})" for name, text in texts.items()
    )
