"""Reports on a few events each, with answers worked out by hand."""
from __future__ import annotations

from datetime import datetime

import pytest

from pagetally.params import ReportParams
from pagetally.plans import content_requests as content
from pagetally.plans import dashboard, journeys, popularity, score, statistics, traffic

from helpers import values

P = ReportParams(as_of=datetime(2024, 2, 1), interval=31, limit=10)
DATES = P.replace(interval=-1, offset=-1, startdate="2024-01-01", enddate="2024-01-31")
DAY = "2024-01-10 10:00:00"


def page(name):
    return f"https://www.example.com/{name}"


def test_dashboard_compares_periods_and_keeps_the_rest(make_events):
    rows = []
    for name, now, before in (("a", 3, 1), ("b", 2, 2), ("c", 1, 0), ("d", 1, 4)):
        rows += [{"id": f"{name}n{i}", "time": "2024-01-30", "url": page(name), "lcp": 1000.0 * (i + 2)} for i in range(now)]
        rows += [{"id": f"{name}o{i}", "time": "2024-01-20", "url": page(name)} for i in range(before)]
    p = P.replace(interval=8, limit=2, url="www.example.com")
    made = {r.url: r for r in dashboard.dashboard(make_events(*rows), p).collect()}
    # "Other" holds c and d now and a and c before; a and "Other" rank first
    assert {u: (r.pageviews, r.pageviews_1) for u, r in made.items()} == {
        page("a"): (300, None), page("b"): (200, 200), "Other": (200, 100),
    }
    a = made[page("a")]
    assert (a.avglcp, a.lcpgood, a.lcpbad, a.avgfid, a.pageviews_diff) == (4000, 33, 33, None, 300)
    assert a.rumshare == pytest.approx(300 / 700 * 100)
    assert [c for c in dashboard.COLUMNS] == dashboard.dashboard(make_events(*rows), p).columns
    rising = dashboard.dashboard(make_events(*rows), p, rising=True)
    assert values(rising, "url", "pageviews_diff") == [
        (page("a"), 200), (page("c"), 100), (page("b"), 0), (page("d"), -300),
    ]


def test_pageviews_fill_slots_and_forecast_the_latest(make_events):
    ev = make_events(
        {"id": "1", "time": "2024-01-28 01:00:00"}, {"id": "1", "time": "2024-01-28 02:00:00"},
        {"id": "2", "time": "2024-01-31 03:00:00"}, {"id": "3", "time": "2024-01-31 04:00:00", "weight": 10},
    )
    made = traffic.pageviews_over_time(ev, P.replace(interval=5))
    assert values(made, "day", "pageviews", "pageviews_forecast", "url", "time") == [
        (31, 110, 105, 1, "2024-01-31 00:00:00+00"), (30, 0, 0, 0, "2024-01-30 00:00:00+00"),
        (29, 0, 0, 0, "2024-01-29 00:00:00+00"), (28, 100, 100, 1, "2024-01-28 00:00:00+00"),
        (27, 0, 0, 0, "2024-01-27 00:00:00+00"),
    ]


def test_hours_of_the_change_to_summer_time(make_events):
    p = P.replace(as_of=datetime(2024, 4, 2), timezone="Europe/Berlin", interval=-1, offset=-1,
                  startdate="2024-03-31", enddate="2024-03-31")
    made = traffic.pageviews_over_time(make_events({"id": "1", "time": "2024-03-31 01:30:00"}), p, granularity=24)
    hours = values(made.orderBy("time"), "hour", "pageviews")
    assert (3, 100) in hours and 2 not in [h for h, _ in hours]


def test_sources_with_a_tie_and_ids_of_two_pages(make_events):
    ev = make_events(
        {"id": "1", "time": DAY, "checkpoint": "click", "source": "s", "url": page("a"), "target": "x"},
        {"id": "1", "time": DAY, "checkpoint": "click", "source": "s", "url": page("a"), "target": "y"},
        {"id": "2", "time": DAY, "checkpoint": "click", "source": "s", "url": page("b")},
        {"id": "3", "time": DAY, "checkpoint": "click", "source": None},
    )
    whole = popularity.sources(ev, P)
    assert values(whole, "source", "ids", "pages", "topurl", "views", "actions", "actions_per_view") == [
        ("s", 2, 2, page("b"), 200, 300, 1.5)
    ]
    by_url = popularity.sources(ev, P, aggregate=False)
    assert values(by_url, "url", "views", "actions") == [(page("a"), 100, 200), (page("b"), 100, 100)]
    both = popularity.sources_targets(ev, P)
    assert values(both, "target", "ids", "user_agents", "views") == [(t, 1, 1, 100) for t in ("x", "y", None)]


def test_targets_split_and_extract(make_events):
    ev = make_events(
        {"id": "1", "time": DAY, "checkpoint": "click", "target": "a.b; c", "url": page("a") + "?q=1"},
        {"id": "2", "time": DAY, "checkpoint": "click", "target": "c", "url": page("a")},
    )
    assert values(popularity.targets(ev, P), "target", "ids", "pages", "views") == [("c", 2, 1, 200), ("a.b", 1, 1, 100)]
    assert values(popularity.targets(ev, P, separator="."), "target", "ids") == [("a.b; c", 1), ("c", 1)]
    assert values(popularity.targets(ev, P, extract=r"\w\.(\w)"), "target", "ids") == [("b", 1)]


def test_not_found_lists_all_sources_in_parts(make_events):
    ev = make_events(*[
        {"id": f"{i}-{c}", "time": DAY, "checkpoint": "404", "source": f"s{i:02d}", "url": page("gone")}
        for i in range(40) for c in range(1 + (i == 7))
    ], {"id": "x", "time": DAY, "checkpoint": "404", "url": page("gone")})
    row = popularity.not_found(ev, P).first()
    assert (row.top_source, row.source_count, row.views, row.part) == ("s07", 40, 4200, 0)
    assert row.all_sources == [f"s{i:02d}" for i in range(40)]
    parts = popularity.not_found(ev, P, listed_sources=10).collect()
    assert [(p.part, len(p.all_sources)) for p in parts] == [(i, 10) for i in range(4)] and {p.views for p in parts} == {4200}
    assert [s for p in parts for s in p.all_sources] == row.all_sources


def test_funnel_counts_an_id_once_for_any(make_events):
    ev = make_events(
        {"id": "1", "time": DAY, "checkpoint": "top"}, {"id": "1", "time": DAY, "checkpoint": "click"},
        {"id": "2", "time": DAY, "checkpoint": "top", "weight": 10}, {"id": "3", "time": DAY, "checkpoint": None},
    )
    assert values(journeys.checkpoint_funnel(ev, P), "checkpoint", "events", "views", "percent_dropoff", "percent_total") == [
        ("any", 2, 110, 0.0, 100.0), ("top", 2, 110, 0.0, 100.0), ("click", 1, 100, 9.1, 90.9),
    ]


def test_bounces(make_events):
    ev = make_events(
        {"id": "1", "time": "2024-01-10 10:00:00", "checkpoint": "enter"},
        {"id": "1", "time": "2024-01-10 10:00:40.9", "checkpoint": "click", "target": "x"},
        {"id": "2", "time": "2024-01-10 10:00:00", "checkpoint": "enter"},
        {"id": "2", "time": "2024-01-10 10:00:10", "checkpoint": "click"},
        {"id": "2", "time": "2024-01-10 10:00:10", "checkpoint": "pagesviewed", "source": "4"},
        {"id": "3", "time": "2024-01-10 10:00:30", "checkpoint": "pagesviewed", "source": "2"},
    )
    row = journeys.bounces(ev, P).first()
    # pages seen average 3, so a visit has 4 pages; durations 0, 10, 40
    assert tuple(row) == (300, 50, 4.0, 0.5, 10, 40)
    nothing = journeys.bounces(ev.filter("checkpoint = 'none'"), P).first()
    assert tuple(nothing) == (0, None, None, None, None, None)


def test_bundles_split_a_busy_id_without_loss(make_events):
    rows = [{"id": "busy", "time": f"2024-01-10 10:{i % 60:02d}:00", "source": f"s{i}"} for i in range(200)]
    rows += [{"id": "busy", "time": "2024-01-10 11:00:00", "source": "copy"}] * 150
    rows += [{"id": "calm", "time": "2024-01-10 09:00:00", "cls": 0.1, "ttfb": 5.0}, {"id": "late", "time": "2024-01-11 00:00:00"}]
    ev, p = make_events(*rows), P.replace(startdate="2024-01-10")
    whole = journeys.bundles(ev, p).collect()
    assert [(r.id, r.rownum, r.part, len(r.events)) for r in whole] == [("calm", 1, 0, 1), ("busy", 2, 0, 350)]
    assert whole[0].events[0].checkpoint == "cwv-cls" and whole[0].events[0].value == 0.1
    assert whole[0].time == "2024-01-10T09:00:00+00:00"
    cut = journeys.bundles(ev, p, bundle_events=40).collect()
    busy = [r for r in cut if r.id == "busy"]
    assert {r.rownum for r in busy} == {2} and [(r.part, len(r.events)) for r in busy] == [(i, 40) for i in range(8)] + [(8, 30)]
    # in order of time across parts
    together = [(e.time, e.source) for r in busy for e in r.events]
    assert together == [(e.time, e.source) for e in whole[1].events] and together == sorted(together)
    assert [r.id for r in journeys.bundles(ev, p, after="calm").collect()] == ["busy"]
    assert journeys.bundles(ev, p, after="nobody").count() == 0


def test_forms(make_events):
    ev = make_events(
        {"id": "1", "time": DAY, "checkpoint": "viewblock", "source": ".form", "url": page("f")},
        {"id": "1", "time": DAY, "checkpoint": "viewblock", "source": ".marketo", "url": page("f")},
        {"id": "1", "time": DAY, "checkpoint": "formsubmit", "source": "a.form", "url": page("f")},
        {"id": "2", "time": DAY, "checkpoint": "formsubmit", "source": "#mktoForm_3", "url": page("f"), "lcp": 700.4},
        {"id": "3", "time": DAY, "checkpoint": "viewblock", "source": ".hero", "url": page("g")},
    )
    assert values(journeys.forms(ev, P), "url", "views", "submissions", "avglcp", "avgcls") == [(page("f"), 200, 200, 700, None)]


def test_content_requests_add_up(make_events):
    api = {"checkpoint": "loadresource", "source": "/q.json"}
    ev = make_events(
        {"id": "1", "time": "2024-01-31 23:59:00"}, *[{"id": "1", "time": "2024-01-31 23:59:00", **api}] * 3,
        {"id": "1", "time": "2024-01-31 00:01:00", "source": "/a.html", "checkpoint": "loadresource"},
        {"id": "2", "time": DAY, "user_agent": "bot:x"}, {"id": "2", "time": DAY, **api},
        {"id": "3", "time": DAY, "checkpoint": "404"}, {"id": "4", "time": DAY, "hostname": "x.hlx.live"},
        {"id": "5", "time": DAY, "url": page("manifest.json")},
    )
    row = content.content_requests(ev, DATES).first()
    assert (row.html_requests, row.json_requests, row.error404_requests) == (400, 400, 100)
    assert (row.cr_pageviews, row.cr_apicalls, row.content_requests) == (100, 60, 160)
    assert (row.cr_margin_of_error, row.month, row.top_host) == (392, 1, "rum.example.net")
    assert row.time == "2024-01-01T00:00:00+00:00"
    year = content.content_requests(ev, DATES, granularity=365).first()
    assert (year.content_requests, year.month, year.time) == (160, None, row.time)


def test_content_request_ids_are_stable(spark):
    made = spark.sql("SELECT sha1(concat('dxc.com', '-m-', unix_micros(TIMESTAMP '2024-03-01 00:00:00Z')))").first()[0]
    assert made == "0ac8dd00086a26594ab800acc5f79c21450ee147"


def test_experiments(make_events):
    rows = []
    for i in range(8):
        variant = "control" if i < 4 else "b"
        rows.append({"id": f"{i}", "time": f"2024-01-{10 + i} 00:00:00", "checkpoint": "experiment", "source": "e", "target": variant})
        if i in (0, 5, 6):
            rows.append({"id": f"{i}", "time": DAY, "checkpoint": "click", "target": "https://x"})
    rows.append({"id": "0", "time": DAY, "checkpoint": "experiment", "source": "f", "target": "b"})
    made = {r.experiment: r for r in statistics.experiments(make_events(*rows), P).collect()}
    e = made["e"]
    assert (e.variant, e.tdiff, e.variant_experimentation_events, e.variant_conversion_events) == ("b", 3, 4, 2)
    assert (e.control_conversions, e.control_conversion_rate, e.variant_conversion_rate) == (100, 0.25, 0.5)
    assert e.pooled_sample_proportion == 0.375
    assert e.pooled_standard_error == pytest.approx((0.375 * (1 - 0.375 * (2 / 400))) ** 0.5)
    assert 0.3 < e.p_value < 0.5 and e.remaining_runtime == 497
    # id 0 converts for e only, and f has no control
    f = made["f"]
    assert (f.control_experimentations, f.variant_conversions, f.p_value) == (0, None, None)
    filtered = statistics.experiments(make_events(*rows), P.replace(targets="http://"), experiment="e").first()
    assert filtered.variant_conversion_events is None


def test_intervals(make_events):
    rows = []
    for day, count, clicks in (("2024-01-02", 4, 1), ("2024-01-12", 4, 3)):
        for i in range(count):
            rows.append({"id": f"{day}{i}", "time": f"{day} 01:00:00", "lcp": 100.0 * (i + 1)})
            if i < clicks:
                rows += [{"id": f"{day}{i}", "time": f"{day} 01:00:01", "checkpoint": "click", "target": f"https://{t}"} for t in "xxy"]
    p = P.replace(targets="https://, http://")
    made = statistics.intervals(make_events(*rows), p, intervals="2024-01-10,new,2024-01-01,old").collect()
    assert [(r.interval_name, r.events, r.conversions, r.lcp_mean, r.lcp_count) for r in made] == [
        ("new", 4, 6, 250.0, 4), ("old", 4, 2, 250.0, 4),
    ]
    assert made[0].conversion_p_value is None and made[1].lcp_p_value == pytest.approx(0.5, abs=1e-6)
    assert made[1].interval_end == "2024-01-10 00:00:00+00"


def test_correlation_of_a_constant_is_unknown(make_events):
    ev = make_events(*[{"id": f"{i}", "time": DAY, "lcp": 100.0 + i} for i in range(20)])
    made = statistics.vitals_correlation(ev, P, ntiles=4).collect()
    assert [r.lcp_percentile for r in made] == [1, 2, 3, 4]
    assert {(r.click_rate, r.correlation, r.click_rate_boost) for r in made} == {(0.0, None, None)}


def test_score_letters(make_events):
    rows = []
    for host, days, lcp in (("a.example.com", 10, 500.0), ("b.example.com", 9, 4000.0)):
        for day in range(1, days + 1):
            for i, step in enumerate(("top", "load", "click")):
                rows.append({
                    "id": f"{host}{day}", "time": f"2024-01-{day:02d} 0{i}:00:00", "checkpoint": step, "hostname": host,
                    "url": f"https://{host}/", "lcp": lcp, "cls": lcp / 8000, "fid": lcp / 10,
                })
    made = {r.host: r for r in score.experience_score(make_events(*rows), P).collect()}
    assert made["a.example.com"].perfscore == "A" and made["b.example.com"].perfscore == "C"
    assert made["a.example.com"].engagementscore == "A"


def test_domains_and_new_hosts(make_events):
    ev = make_events(
        {"id": "1", "time": "2024-01-01 01:00:00", "host": "publish-p7-e8.cloud.net"}, {"id": "2", "time": "2024-01-30"},
        {"id": "3", "time": "2023-11-01", "hostname": "gone.example.com"},
        {"id": "4", "time": "2024-01-31 05:00:00", "hostname": "new.example.com"},
        {"id": "5", "time": "2024-01-31 05:00:00", "hostname": "x.aem.live"},
    )
    p = P.replace(as_of=datetime(2024, 1, 31, 12), interval=365)
    made = traffic.domain_list(ev, p)
    assert values(made, "hostname", "current_month_visits", "total_visits", "first_visit", "program_id", "environment_id") == [
        ("example.com", 200, 200, "2024-01-01", 7, 8),
    ]
    hints = traffic.golive_hints(ev, P.replace(as_of=datetime(2024, 2, 1, 12)))
    assert [r.hostname for r in hints.collect()] == ["new.example.com"]


def test_pivot_keeps_busy_hosts(make_events):
    ev = make_events(
        {"id": "1", "time": "2023-03-05", "weight": 1000}, {"id": "2", "time": "2024-01-05", "weight": 1000},
        {"id": "3", "time": "2023-03-05", "weight": 1000, "hostname": "old.example.com"},
    )
    row = traffic.pageviews_pivot(ev, P.replace(interval=365)).collect()
    assert [r.hostname for r in row] == ["example.com"]
    assert row[0]["2023-Mar"] == row[0]["2024-Jan"] == 1000 and len(row[0]) == 13
