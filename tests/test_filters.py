from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagetally.functions import filters, sql
from pagetally.functions import fixed_values as fixed
from pagetally.operators import scan
from pagetally.params import ReportParams


def kept(spark, predicate, *names):
    rows = spark.createDataFrame([(n,) for n in names], "v string")
    return [r.v for r in rows.filter(predicate(F.col("v"))).collect()]


URLS = [
    "https://a.com/p", "https://a.com/p?x=1", "https://a.com/pq", "http://a.com/p", "http://localhost:3000/p",
    "https://b.com/p",
]


@pytest.mark.parametrize("wanted, expected", [
    ("a.com/p", URLS[:3]), ("a.com/p$", URLS[:1]), ("a.com/p?", URLS[:2]), ("localhost:3000", [URLS[4]]),
])
def test_url_modes(spark, wanted, expected):
    assert kept(spark, lambda v: filters.url_matches(v, wanted), *URLS) == expected


def test_hosts(spark):
    hosts = ["a.com", "localhost", None, "x.hlx.live", "www.hlx.live", "1.2.3.4", "bad host", ""]
    assert kept(spark, lambda v: filters.host_matches(v, "localhost:3000/p"), *hosts) == ["localhost"]
    assert kept(spark, filters.valid_hostname, *hosts) == [h for h in hosts if h not in (None, "bad host")]
    public = kept(spark, lambda v: filters.public_hosts(v, fixed.EXCLUDED_SUFFIXES_PIVOT, fixed.READMITTED_HOST), *hosts)
    assert public == ["a.com", "www.hlx.live", "bad host"]


def test_lists_and_prefixes(spark):
    assert filters.split_list("a.com, b.com,") == ["a.com", "b.com"]
    assert kept(spark, lambda v: filters.starts_with_any(v, "x_, y"), "x_1", "xa1", "y", None) == ["x_1", "y"]
    assert filters.starts_with_any(F.col("v"), "-") is None


def test_devices(spark):
    agents = ["desktop:mac", "mobile:ios", "bot:x", None]
    assert kept(spark, lambda v: filters.device_class(v, "nobot"), *agents) == agents[:2]
    assert kept(spark, lambda v: filters.device_class(v, "mobile"), *agents) == ["mobile:ios"]
    assert filters.device_class(F.col("v"), "all") is None


def test_sql_functions_agree(spark, make_events):
    from datetime import datetime

    from pagetally.functions import sql
    from pagetally.operators import scan
    from pagetally.params import ReportParams

    rows = make_events(*[
        {"id": str(i), "time": "2024-01-10", "url": u, "hostname": u.split("/")[2].split(":")[0]} for i, u in enumerate(URLS)
    ], {"id": "odd", "time": "2024-01-10", "weight": 7}, {"id": "bad", "time": "2024-01-10", "hostname": "bad host"})
    rows.createOrReplaceTempView("few_events")
    sql.register(spark, "few_events")
    p = ReportParams(as_of=datetime(2024, 2, 1), interval=31)
    for wanted in ("-", "a.com", "a.com/p", "a.com/p$", "a.com/p?", "localhost:3000/p", "a.com, b.com,"):
        listed = spark.sql(
            "SELECT id FROM rum_events(:w, TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', 'all')", args={"w": wanted}
        )
        assert {r.id for r in listed.collect()} == {r.id for r in scan.events(rows, p.replace(url=wanted)).collect()}, wanted


@pytest.mark.parametrize("wanted", ["-", "a.com/p", "a.com/p$", "a.com/p?", "a.com/p?$", "a.com/p$?", "localhost:3000/x", "localhost:3000/x$", "localhost:3000/x?"])
def test_both_forms_of_the_url_filter_agree(spark, make_events, wanted):
    make_events({"time": "2024-01-05T00:00:00"}).createOrReplaceTempView("few_events")
    sql.register(spark, "few_events")
    pages = ["https://a.com/p", "https://a.com/p?", "https://a.com/p?q=1", "https://a.com/p$", "https://a.com/pq", "http://a.com/p", "http://localhost:3000/x", "https://localhost:3000/x?y", "http://localhost:3000/xy"]
    rows = spark.createDataFrame([(x,) for x in pages], "url string")
    condition = filters.url_matches(F.col("url"), wanted)
    made = rows.withColumn("a", F.lit(True) if condition is None else condition).withColumn("b", F.expr(f"url_matches(url, '{wanted}')"))
    assert [r.a for r in made.collect()] == [r.b for r in made.collect()]


def test_a_secret_needs_the_key_table(make_events):
    rows = make_events({"time": "2024-01-05T00:00:00"})
    with pytest.raises(ValueError, match="table of keys"):
        scan.events(rows, ReportParams(domainkey="wrong"))
