"""Readers and writer of event and request-log tables in parquet."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("hostname", "host", "user_agent")]
    + [T.StructField("time", T.TimestampType()), T.StructField("url", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("lcp", "fid", "inp", "cls", "ttfb")]
    + [T.StructField(c, T.StringType()) for c in ("referer", "id", "source", "target")]
    + [T.StructField("weight", T.IntegerType()), T.StructField("checkpoint", T.StringType())]
    + [T.StructField("generation", T.StringType())]
)

KEY_SCHEMA = T.StructType([
    T.StructField("hostname_prefix", T.StringType()), T.StructField("key_bytes", T.StringType()),
    T.StructField("revoke_date", T.DateType()), T.StructField("readonly", T.BooleanType()),
    T.StructField("create_date", T.DateType()), T.StructField("parent_key_bytes", T.StringType()),
    T.StructField("note", T.StringType()),
])

# File size aimed at by the writer, in rows: some 256 MB of compressed events.
ROWS_PER_FILE = 5_000_000


def read_events(spark: SparkSession, *paths: str, dated: bool = True) -> DataFrame:
    """Events of one or more collectors as one table; a column that a collector lacks is null.

    The schema is given, not inferred. ``dated`` tables are partitioned by ``event_date``.
    """
    partition = [T.StructField("event_date", T.DateType())] if dated else []
    schema = T.StructType(EVENT_SCHEMA.fields + partition)
    return reduce(DataFrame.unionByName, (spark.read.schema(schema).parquet(path) for path in paths))


def write_events(ev: DataFrame, path: str, mode: str = "append") -> None:
    """Store events by date, and by host and time within a date.

    A range layout splits a busy day or host over several files, and the order lets a filter on
    host and time skip row groups.
    """
    # of the instant in UTC, whatever the zone of the session
    day = F.date_from_unix_date(F.floor(F.unix_micros("time") / 86_400_000_000).cast("int"))
    dated = ev.withColumn("event_date", day)
    order = ["event_date", "hostname", "time"]
    dated.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option(
        "maxRecordsPerFile", ROWS_PER_FILE
    ).partitionBy("event_date").parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request log partitioned by ``month`` (``YYYYMM``); all columns are text."""
    names = (
        "req_http_x_owner", "req_http_x_repo", "req_http_x_ref", "req_http_x_url", "req_http_referer",
        "req_url", "resp_http_content_type", "status_code", "time_start_usec", "month",
    )
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).parquet(path)
