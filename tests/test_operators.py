"""Order, quantiles, shares and access against plain Python, with very uneven data."""
from __future__ import annotations

import itertools
import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pagetally.functions import metrics
from pagetally.operators import access, ordering, percentile, popularity, scan
from pagetally.operators.materialise import materialise
from pagetally.params import ReportParams
from pagetally.sources.files import KEY_SCHEMA

P = ReportParams(as_of=datetime(2024, 2, 1), interval=31)


@pytest.fixture(scope="module")
def uneven():
    """Rows (group, value, id): a third in one group, and a third of the values equal."""
    dice = random.Random(7)
    return [
        ("hot" if dice.random() < 0.34 else f"g{dice.randrange(40)}",
         5.0 if dice.random() < 0.34 else dice.random() * 100, i)
        for i in range(30_000)
    ]


@pytest.fixture(scope="module")
def frame(spark, uneven):
    return spark.createDataFrame(uneven, "g string, v double, id long").repartition(8)


def test_global_row_number(frame, uneven):
    numbered = ordering.global_row_number(frame, "v", "id").collect()
    wanted = {row[2]: i + 1 for i, row in enumerate(sorted(uneven, key=lambda r: (r[1], r[2])))}
    assert {r.id: r.rownum for r in numbered} == wanted


@pytest.mark.parametrize("tiles", [1, 7, 1000])
def test_ntile_takes_odd_rows_first(frame, tiles):
    few = frame.filter(F.col("id") < 500)
    sizes = [r["count"] for r in ordering.ntile(few, tiles, "v", "id").groupBy("tile").count().orderBy("tile").collect()]
    whole, odd = divmod(500, tiles)
    assert sizes == [s for s in [whole + 1] * odd + [whole] * (tiles - odd) if s]


@pytest.mark.parametrize("share", [0.05, 0.5, 0.75, 1.0])
def test_exact_quantile(frame, uneven, share):
    def rank(values):
        return sorted(values)[max(math.ceil(len(values) * share), 1) - 1]

    groups: dict[str, list[float]] = {}
    for g, v, _ in uneven:
        groups.setdefault(g, []).append(v)
    made = percentile.exact_quantile(frame, ["g"], "v", share, "q").collect()
    assert {r.g: r.q for r in made} == {g: rank(vs) for g, vs in groups.items()}
    assert percentile.exact_quantile(frame, [], "v", share, "q").first().q == rank([v for _, v, _ in uneven])


def test_exact_quantiles_of_odd_values(spark):
    odd = [0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, math.inf, -math.inf, math.nan, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 2.0**52 + 1, 3.5, -3.5, 1024.0, math.nextafter(1024.0, 0)]
    rows = [(g, v) for g in ("a", None) for v in odd] + [("a", None), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {f"s{i}": i / len(odd) for i in range(len(odd) + 1)}
    made = percentile.exact_quantiles(table, ["g"], "v", shares).collect()
    ordered = sorted(odd, key=lambda v: (math.isnan(v), v))
    assert {r.g for r in made} == {"a", None} and len(made) == 2
    for row in made:
        found = [row[f"s{i}"] for i in range(len(odd) + 1)]
        assert [str(v + 0.0) for v in found] == [str(ordered[max(i, 1) - 1] + 0.0) for i in range(len(odd) + 1)]
    digits = table.select("v", percentile.radix_digit(F.col("v")).alias("d")).filter("v is not null").orderBy("v").collect()
    assert all(a.d <= b.d for a, b in zip(digits, digits[1:]))


def test_quantile_of_a_hot_group_sorts_no_rows_together(spark):
    """A million different values of one group: tasks get digits or the values of a digit, and nothing is dealt by ranges."""
    n = 1_000_000
    table = spark.range(0, n, 1, 8).select(F.lit("hot").alias("g"), ((F.col("id") * 7919 % n) / 1000.0).alias("v"))
    made = percentile.exact_quantile(table, ["g"], "v", 0.75, "q")
    assert made.first().q == (math.ceil(n * 0.75) - 1) / 1000.0
    assert "rangepartitioning" not in made._jdf.queryExecution().toString()
    digits = table.groupBy(percentile.radix_digit(F.col("v")).alias("d")).count()
    assert digits.count() < 400_000 and digits.agg(F.max("count")).first()[0] < 100


def test_sketch_is_within_its_rank_error(frame, uneven):
    ordered = sorted(v for _, v, _ in uneven)
    found = frame.agg(metrics.quantile(F.col("v"), 0.75).alias("q")).first().q
    slack = math.ceil(len(ordered) / metrics.ACCURACY) + 1
    middle = math.ceil(len(ordered) * 0.75) - 1
    assert ordered[middle - slack] <= found <= ordered[middle + slack]


def test_top_values_break_ties_by_value(spark):
    rows = spark.createDataFrame(
        [("a", "x", 1), ("a", "x", 1), ("a", "y", 9), ("b", "x", 1), ("b", "y", 1), ("b", None, 5), ("c", None, 1)],
        "g string, v string, w int",
    )
    by_count = {r.g: r.top for r in popularity.top_value_by_count(rows, ["g"], "v", "top").collect()}
    by_sum = {r.g: r.top for r in popularity.top_value_by_sum(rows, ["g"], "v", "w", "top").collect()}
    assert by_count == {"a": "x", "b": "y", "c": None}
    assert by_sum == {"a": "y", "b": "y", "c": None}


def test_label_top_keeps_every_row(frame, uneven):
    sums = materialise(frame.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    labelled = {r.label: r.n for r in ordering.label_top(sums, 2, "n", "g").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    assert len(labelled) == 3 and labelled["hot"] > 9000 and sum(labelled.values()) == len(uneven)


def test_paging_covers_all_rows_once(spark):
    rows = materialise(spark.range(10).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("k")))
    cursor, seen = None, []
    for _ in range(5):
        page = ordering.page_after(rows, ["k", "id"], cursor, 4).orderBy("rownum").collect()
        seen += [(r.rownum, r.k, r.id) for r in page]
        if not page:
            break
        cursor = page[-1].id
    assert [n for n, _, _ in seen] == list(range(1, 11))
    assert [(k, i) for _, k, i in seen] == sorted((k, i) for _, k, i in seen)
    assert ordering.page_after(rows, ["k", "id"], "nobody", 4).count() == 0


def test_delivery_in_parts_holds_all_rows(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 91, "0").alias("v"))
    size = len('{"v":""}') + 91
    made = ordering.delivery_parts(rows, "v", max_bytes=size * 50).collect()
    assert sorted((int(r.v), r.part) for r in made) == [(i, i // 50) for i in range(1000)]
    few = ordering.delivery_parts(rows.limit(3), "v", max_bytes=1).collect()
    assert len(few) == 3 and len({r.part for r in few}) == 3


def test_margins_and_statistics(spark):
    margin = metrics.to_int(metrics.margin_of_error(F.col("w"), F.col("n")))
    rows = spark.createDataFrame([(100, 284), (100, 199 * 4), (1, 50)], "w int, n int")
    assert [r[0] for r in rows.select(margin).collect()] == [3303, 5530, 0]
    cdf = spark.createDataFrame([(0.0,), (1.96,), (-1.96,)], "x double").select(metrics.normal_cdf(F.col("x")))
    assert [round(r[0], 4) for r in cdf.collect()] == [0.5, 0.975, 0.025]
    pairs = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, 6.5, 3.0), (None, 1.0, 3.0)], "x double, y double, c double")
    found = pairs.agg(metrics.correlation(F.col("x"), F.col("y")), metrics.correlation(F.col("x"), F.col("c"))).first()
    assert found[0] == pytest.approx(2.25 / (61 / 12) ** 0.5) and found[1] is None


def test_to_int_rounds_halves_away_from_zero(spark):
    rows = spark.createDataFrame([(0.5,), (-0.5,), (2.5,), (None,)], "x double")
    assert [r[0] for r in rows.select(metrics.to_int(F.col("x"))).collect()] == [1, -1, 3, None]


def test_weighted_mean_counts_missing_values_in_the_weight(spark):
    rows = spark.createDataFrame([(10.0, 1), (None, 1)], "v double, w int")
    assert rows.agg(metrics.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 5.0


# ---- keys


@pytest.fixture(scope="module")
def hosts(make_events):
    urls = ["https://www.example.com/a", "https://example.com/a", "https://notexample.com/a", "http://example.com/a",
            "https://other.org/x.example.com/"]
    return make_events(*[
        {"id": f"i{n}", "time": "2024-01-10", "url": u, "hostname": u.split("/")[2]} for n, u in enumerate(urls)
    ])


def key_rows(spark, *rows):
    full = [(prefix, revoke, readonly, secret) for prefix, secret, revoke, readonly in rows]
    frame = spark.createDataFrame(full, "hostname_prefix string, revoke_date date, readonly boolean, secret string")
    return frame.select(
        "hostname_prefix", access.key_digest(F.col("secret")).alias("key_bytes"), "revoke_date", "readonly",
        F.lit(None).cast("date").alias("create_date"), F.lit(None).cast("string").alias("parent_key_bytes"),
        F.lit("").alias("note"),
    ).to(KEY_SCHEMA)


def seen(hosts, keys, secret, url="-"):
    rows = scan.events(hosts, P.replace(domainkey=secret, url=url), keys)
    return sorted(r.id for r in rows.collect())


def test_key_opens_its_site_once(spark, hosts):
    keys = key_rows(spark, ("example.com", "k", None, True), ("example.com", "k", date(2024, 2, 2), True))
    assert seen(hosts, keys, "k", "example.com,www.example.com") == ["i0", "i1"]
    assert seen(hosts, keys, "k") == []  # a site key does not cover a request for everything
    assert seen(hosts, keys, "wrong", "example.com") == []


def test_revoked_and_global_keys(spark, hosts):
    keys = key_rows(spark, ("", "old", date(2024, 2, 1), True), ("", "new", None, True))
    assert seen(hosts, keys, "old") == []
    assert seen(hosts, keys, "new") == ["i0", "i1", "i2", "i3", "i4"]


def test_secret_with_many_sites_gives_the_same_rows(spark, hosts):
    listed = ",".join(["example.com", "www.example.com", "other.org"] + [f"s{n}.net" for n in range(200)])
    rows = [("example.com", "k", None, True)] + [(f"s{n}.net", "k", None, True) for n in range(200)]
    keys = key_rows(spark, *rows)
    assert seen(hosts, keys, "k", listed) == ["i0", "i1"]


def test_nested_sites_of_a_key_do_not_multiply_rows(spark, hosts):
    listed = "example.com,www.example.com,other.org"
    keys = key_rows(spark, *[(prefix, "k", None, True) for prefix in ("example.com", "www.example.com", "com")])
    assert seen(hosts, keys, "k", listed) == ["i0", "i1"]
    every = key_rows(spark, *[(prefix, "k", None, True) for prefix in ("", "example.com", "www.example.com")])
    assert seen(hosts, every, "k", listed) == ["i0", "i1", "i3", "i4"]
    assert seen(hosts, every, "k") == ["i0", "i1", "i2", "i3", "i4"]


@pytest.mark.parametrize("host, found", [
    ("a.b.com", ["", "com", "b.com", "a.b.com"]), ("x.a.b.com", ["", "com", "b.com", "a.b.com"]), ("com", ["", "com"]),
    ("b.com.", ["", "com.", "b.com."]), ("b.com:80", ["", "com:80", "b.com:80"]), ("", [""]), (None, ["", None]),
])
def test_host_and_parents(spark, host, found):
    row = spark.createDataFrame([(host,)], "host string").select(access.host_and_parents(F.col("host"), 3))
    assert row.first()[0] == found


def test_outermost_prefixes(spark):
    given = ["b.com", "a.b.com", "xb.com", "b.com", "y.a.b.com", "net", "x.net", None]
    rows = spark.createDataFrame([(g,) for g in given], "_prefix string")
    assert sorted(r[0] for r in access.outermost(rows, 4).collect()) == ["b.com", "net", "xb.com"]
    rows = spark.createDataFrame([("",), ("b.com",)], "_prefix string")
    assert [r[0] for r in access.outermost(rows, 2).collect()] == [""]
    assert access.outermost(rows.limit(0), 2).collect() == []


def test_many_keys_and_hosts_against_brute_force(spark, make_events):
    """Made hosts and prefixes of every depth, each prefix in a key of its own and all in one."""
    parts = ["a", "b", "ab"]
    names = [".".join(x) for n in (1, 2, 3) for x in itertools.product(parts, repeat=n)]
    rows = make_events(*[{"id": f"{n}", "time": "2024-01-10", "url": f"https://{h}/p", "hostname": h} for n, h in enumerate(names)])
    chosen = random.Random(3).sample(names, 12)
    keys = key_rows(spark, *[(prefix, secret, None, True) for prefix in chosen for secret in ("all", prefix)])
    listed = ",".join(names)
    for secret, prefixes in [("all", chosen), *[(x, [x]) for x in chosen[:3]]]:
        opened = [f"{n}" for n, h in enumerate(names) if any(h == x or h.endswith("." + x) for x in prefixes)]
        assert seen(rows, keys, secret, listed) == sorted(opened)


def test_plan_of_a_key(spark, make_events, tmp_path, monkeypatch):
    """One scan of events and of keys, no shuffle of events, nothing run to make the plan."""
    make_events({"id": "a", "time": "2024-01-10"}).write.parquet(str(tmp_path / "events"))
    key_rows(spark, ("example.com", "k", None, True)).write.parquet(str(tmp_path / "keys"))
    ev, keys = spark.read.parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "keys"))
    monkeypatch.setattr(type(ev), "collect", None)
    rows = scan.events(ev, P.replace(domainkey="k", url="www.example.com"), keys)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "NestedLoop" not in plan


def test_privileges(spark):
    keys = key_rows(spark, ("", "r", None, True), ("", "rw", None, True), ("", "rw", None, False), ("a.com", "s", None, False))
    found = {s: tuple(access.privileges(keys, s, P).first()) for s in ("r", "rw", "s", "nobody")}
    assert found == {"r": (True, False), "rw": (True, True), "s": (False, False), "nobody": (False, False)}
