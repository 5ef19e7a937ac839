"""Jobs that change tables: access keys, organisation ids, audit scores.

Key and organisation tables are snapshot tables. Each job checks the caller's key first and then
writes one new snapshot that holds all its effects.
"""
from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions import fixed_values as fixed
from pagetally.functions.filters import split_list
from pagetally.functions.timeframe import today
from pagetally.operators.access import is_live, key_digest, live_keys, may_change
from pagetally.params import ReportParams
from pagetally.sources import snapshots
from pagetally.sources.files import KEY_SCHEMA

DOMAIN_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()), T.StructField("ims_org_id", T.StringType()),
])
AUDIT_SCORES = (
    "perf_score", "acc_score", "bp_score", "seo_score", "perf_tti_score", "perf_speed_idx",
    "seo_crawl_score", "seo_crawl_anchors_score", "net_servr_time", "net_nl", "net_mainthread_work_score",
    "net_total_blocking_score", "net_img_optimization_score", "third_party_score",
)
AUDIT_SCHEMA = T.StructType(
    [T.StructField("url", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in AUDIT_SCORES]
    + [T.StructField(c, T.StringType()) for c in ("device_type", "time", "audit_ref")]
)


def expire(keys: DataFrame, of_host: Column, p: ReportParams, grace_days: int) -> DataFrame:
    """Let the live keys of some hosts end after the grace period; without one they stay as they are."""
    if grace_days <= 0:
        return keys
    end = F.lit(today(p) + timedelta(days=grace_days))
    return keys.withColumn("revoke_date", F.when(of_host & is_live(p), end).otherwise(F.col("revoke_date")))


def issue(
    hosts: DataFrame, p: ReportParams, new_key: str, expiry: str = "-", readonly: bool = True, note: str = "-"
) -> DataFrame:
    """Key rows for a table of host names."""
    return hosts.select(
        F.col("hostname_prefix"), key_digest(new_key).alias("key_bytes"),
        F.lit(None if expiry == "-" else date.fromisoformat(expiry)).cast("date").alias("revoke_date"),
        F.lit(readonly).alias("readonly"), F.lit(today(p)).alias("create_date"),
        key_digest(p.domainkey or "").alias("parent_key_bytes"), F.lit("" if note == "-" else note).alias("note"),
    )


def rotated(
    keys: DataFrame, p: ReportParams, new_key: str, grace_days: int = -1, expiry: str = "-",
    readonly: bool = True, note: str = "-",
) -> DataFrame:
    """Key table with new keys for the hosts listed in ``p.url`` and the old ones expiring."""
    hosts = [""] if p.url == "-" else split_list(p.url)
    fresh = keys.sparkSession.createDataFrame([(h,) for h in hosts], "hostname_prefix string")
    old = expire(keys, F.col("hostname_prefix").isin(hosts), p, grace_days)
    return old.unionByName(issue(fresh, p, new_key, expiry, readonly, note))


def revoked(keys: DataFrame, p: ReportParams, secret: str, grace_days: int = 1) -> DataFrame:
    """Key table with one key ending after the grace period, for the hosts that ``p.url`` names."""
    prefix = "" if p.url == "-" else p.url
    mine = (F.col("key_bytes") == key_digest(secret)) & (F.col("hostname_prefix") == prefix)
    end = F.lit(today(p) + timedelta(days=grace_days))
    return keys.withColumn("revoke_date", F.when(mine, end).otherwise(F.col("revoke_date")))


def rotate_keys(spark: SparkSession, path: str, p: ReportParams, new_key: str = "-", **options) -> DataFrame:
    """Run ``rotated`` on the key table if the caller may, and report one status row."""
    base = snapshots.newest(spark, path)
    keys = snapshots.read(spark, path, KEY_SCHEMA, base)
    key = None
    if may_change(keys, p.domainkey or "", p):
        key = new_key if new_key != "-" else str(uuid.uuid4())
        keys = snapshots.write(rotated(keys, p, key, **options), path, base)
    url = "" if p.url == "-" else p.url
    mine = live_keys(keys, p.domainkey or "", p).filter(F.col("hostname_prefix").isin("", p.url))
    expiry = options.get("expiry", "-")
    row = (key, url, "success" if mine.limit(1).count() else "failure", None if expiry == "-" else expiry)
    return spark.createDataFrame([row], "key string, hostname_prefix string, status string, revoke_date string")


def revoke_key(spark: SparkSession, path: str, p: ReportParams, secret: str, grace_days: int = 1) -> DataFrame:
    """Run ``revoked`` on the key table if the caller may, and report one status row."""
    base = snapshots.newest(spark, path)
    keys = snapshots.read(spark, path, KEY_SCHEMA, base)
    key = None
    if may_change(keys, p.domainkey or "", p):
        key = secret
        keys = snapshots.write(revoked(keys, p, secret, grace_days), path, base)
    url = "" if p.url == "-" else p.url
    ended = keys.filter(
        (F.col("key_bytes") == F.sha2(F.lit(key), 512)) & F.col("revoke_date").isNotNull()
        & F.col("hostname_prefix").isin("", p.url)
    )
    row = (key, url, "success" if ended.limit(1).count() else "failure")
    return spark.createDataFrame([row], "key string, hostname_prefix string, status string")


def upserted(info: DataFrame, changes: DataFrame) -> DataFrame:
    """Domain table with the organisation id of each changed domain set or added; two changes for one domain are refused."""
    twice = F.raise_error(F.concat(F.lit("two changes for the domain "), F.col("domain")))
    changes = changes.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("ims_org_id").alias("_new")).select(
        "domain", F.when(F.col("n") == 1, F.col("_new")).otherwise(twice).alias("_new"), F.lit(True).alias("_changed")
    )
    merged = info.join(changes, "domain", "full")
    org = F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("ims_org_id"))
    return merged.select("domain", org.alias("ims_org_id"))


def update_domain_info(
    spark: SparkSession, path: str, keys: DataFrame, p: ReportParams, changes: DataFrame
) -> DataFrame:
    """Write ``upserted`` as the new snapshot; only for a global read-write key."""
    base = snapshots.newest(spark, path)
    info = snapshots.read(spark, path, DOMAIN_SCHEMA, base)
    if not may_change(keys, p.domainkey or "", p, only_global=True):
        return info
    return snapshots.write(upserted(info, changes), path, base)


def batch_name(batch: DataFrame) -> str:
    """A name for the rows of a batch, whatever their order: their count and sums of two hashes of each."""
    # hashes go past nulls, so where they stand is hashed too
    columns = [*sorted(batch.columns), *[F.col(c).isNull() for c in sorted(batch.columns)]]
    row = batch.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))
    ).first()
    return "-".join(str(x or 0).replace("-", "m") for x in row)


def add_audits(spark: SparkSession, path: str, keys: DataFrame, p: ReportParams, audits: DataFrame) -> DataFrame:
    """Store a batch of audit scores and report how often each of its rows is stored.

    A row is let in when the caller's read-write key is global or is for exactly its url. Rows lie in a partition for each
    audit and batch; a batch is named by its content and replaces its own partitions, so that one that is sent
    again, by a job that was retried or by its caller, is stored once. Other batches of the same audit stay. Only the
    partitions of the batch's audits, some few references, are read back.
    """
    open_to = live_keys(keys, p.domainkey or "", p).filter(~F.col("readonly")).select("hostname_prefix").distinct()
    if may_change(keys, p.domainkey or "", p, only_global=True):
        allowed = audits
    else:
        allowed = audits.join(open_to, audits["url"] == open_to["hostname_prefix"], "left_semi")
    batch = allowed.select(*AUDIT_SCHEMA.names)
    batch.withColumn("batch", F.lit(batch_name(batch))).hint("rebalance", "audit_ref").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("audit_ref", "batch").parquet(path)
    references = [r[0] for r in audits.select("audit_ref").distinct().collect()]
    stored = stored_audits(spark, path, references)
    identity = ["url", "time", "audit_ref", "device_type"]
    counted = stored.join(audits.select(*identity).distinct(), identity, "left_semi").groupBy(
        "url", "device_type", "time", "audit_ref"
    ).agg(F.count(F.lit(1)).alias("number_of_row_instances"))
    return counted.select(
        F.lit(fixed.AUDIT_STORED).alias("status"), "url", "device_type", "time", "audit_ref",
        "number_of_row_instances",
    )


def stored_audits(spark: SparkSession, path: str, references: list[str] | None = None) -> DataFrame:
    """Stored audit scores; of some audits only, by their partitions, if references are named."""
    stored = spark.read.schema(T.StructType([*AUDIT_SCHEMA.fields, T.StructField("batch", T.StringType())])).parquet(path)
    if references is not None:
        stored = stored.filter(F.col("audit_ref").isin(references))
    return stored.drop("batch")
