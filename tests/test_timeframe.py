from __future__ import annotations

import zoneinfo
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pagetally.functions.timeframe import TimeRange, clean_timezone, instant_text, time_range, truncate
from pagetally.operators.slots import UNITS, named_intervals, slots
from pagetally.params import ReportParams

P = ReportParams(as_of=datetime(2024, 2, 1, 15, 30), interval=7)


def test_days_back_from_midnight():
    assert time_range(P) == TimeRange(datetime(2024, 1, 25), datetime(2024, 2, 1))
    assert time_range(P.replace(offset=3)) == TimeRange(datetime(2024, 1, 22), datetime(2024, 1, 29))
    assert time_range(P, scale=7).lo == datetime(2023, 12, 14)


def test_midnight_is_that_of_the_zone():
    span = time_range(P.replace(timezone="Asia/Tokyo"))
    # it is already February 2 in Tokyo, whose midnight was at 15:00
    assert span.hi == datetime(2024, 2, 1, 15)
    assert clean_timezone("undefined") == clean_timezone("") == "GMT"


def test_dates_take_effect_when_interval_is_negative():
    p = P.replace(interval=-1, offset=-1, startdate="2024-01-03", enddate="2024-01-04")
    assert time_range(p) == TimeRange(datetime(2024, 1, 3), datetime(2024, 1, 5))
    assert time_range(p, closed=True) == TimeRange(datetime(2024, 1, 3), datetime(2024, 1, 4), closed=True)
    future = p.replace(enddate="2024-12-31")
    assert time_range(future).hi == P.as_of
    assert time_range(p).before() == TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 3))


@pytest.mark.parametrize("unit", list(UNITS.values()))
def test_slots_are_the_truncations_of_their_range(spark, unit):
    # the range holds the change to summer time in Berlin
    span = TimeRange(datetime(2024, 3, 29, 5), datetime(2024, 4, 2, 3))
    minutes = spark.range(int((span.hi - span.lo).total_seconds() // 60))
    start = F.lit(int((span.lo - datetime(1970, 1, 1)).total_seconds()))
    times = minutes.select(F.timestamp_seconds(start + F.col("id") * 60).alias("time"))
    wanted = {r[0] for r in times.select(truncate(F.col("time"), unit, "Europe/Berlin")).distinct().collect()}
    assert {r[0] for r in slots(spark, span, unit, "Europe/Berlin").collect()} == wanted


def test_instant_text(spark):
    time = F.expr("TIMESTAMP '2024-07-01 12:00:00Z'")
    row = spark.range(1).select(*[
        instant_text(time, z).alias(n)
        for n, z in (("utc", "UTC"), ("pacific", "America/Los_Angeles"), ("india", "Asia/Kolkata"))
    ]).first()
    assert tuple(row) == ("2024-07-01 12:00:00+00", "2024-07-01 05:00:00-07", "2024-07-01 17:30:00+05:30")


def test_named_intervals_end_where_the_next_begins():
    made = named_intervals("2024-01-20,b,2024-01-10,a,2024-01-25", P)
    assert made == [
        ("a", datetime(2024, 1, 10), datetime(2024, 1, 20)), ("b", datetime(2024, 1, 20), datetime(2024, 1, 25)),
        (None, datetime(2024, 1, 25), P.as_of),
    ]


def test_parameters_from_text():
    p = ReportParams.from_mapping({"limit": "5", "url": "a.com", "as_of": "2024-01-01", "other": 1})
    assert (p.limit, p.url, p.as_of) == (5, "a.com", datetime(2024, 1, 1))
    with pytest.raises(ValueError, match="more than once"):
        ReportParams.from_mapping({"url": ["a.com", "b.com"]})


@pytest.mark.parametrize(("zone", "begin", "end"), [
    ("Asia/Kolkata", "2024-01-01T00:00:00", "2024-01-02T00:00:00"), ("Europe/Berlin", "2024-10-26T22:00:00", "2024-10-27T23:00:00"),
    ("Europe/Berlin", "2024-03-30T23:00:00", "2024-03-31T22:00:00"), ("UTC", "2024-01-01T00:00:00", "2024-01-01T05:00:00"),
])
def test_hours_of_any_zone_and_over_clock_changes(spark, zone, begin, end):
    lo, hi = (datetime.fromisoformat(x) for x in (begin, end))
    made = [r.slot for r in slots(spark, TimeRange(lo, hi), "hour", zone).collect()]
    times = [lo + timedelta(minutes=13 * i) for i in range(int((hi - lo) / timedelta(minutes=13)))]
    rows = spark.createDataFrame([(x.replace(tzinfo=timezone.utc),) for x in times], "time timestamp")
    found = {r.h for r in rows.select(truncate(F.col("time"), "hour", zone).alias("h")).collect()}
    assert found == set(made) and len(made) == len(found)
    local = zoneinfo.ZoneInfo(zone)
    assert {x.replace(tzinfo=timezone.utc).astimezone(local).minute for x in made} == {0}
