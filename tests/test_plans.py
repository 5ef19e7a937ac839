"""Plans that must hold at scale: one look at the events, filters in the file scan, no pairing of all rows."""
from __future__ import annotations

from datetime import datetime

import pytest

from checks import views
from pagetally.operators import materialise as writing
from pagetally.operators import ordering
from pagetally.params import ReportParams
from pagetally.plans import content_requests, dashboard, journeys, popularity, score, statistics, traffic

SF_DIR = "/root/testdata/sf0.001"
P = ReportParams(as_of=datetime(2024, 2, 1), interval=31)
DATES = P.replace(interval=-1, offset=-1, startdate="2024-01-01", enddate="2024-01-31")

REPORTS = {
    "dashboard": lambda raw: dashboard.dashboard(raw, P),
    "rising": lambda raw: dashboard.dashboard(raw, P, rising=True),
    "pageviews": lambda raw: traffic.pageviews_over_time(raw, P),
    "pivot": lambda raw: traffic.pageviews_pivot(raw, P),
    "domains": lambda raw: traffic.domain_list(raw, P),
    "golive": lambda raw: traffic.golive_hints(raw, P),
    "sources": lambda raw: popularity.sources(raw, P),
    "sources_targets": lambda raw: popularity.sources_targets(raw, P),
    "targets": lambda raw: popularity.targets(raw, P),
    "not_found": lambda raw: popularity.not_found(raw, P),
    "urls": lambda raw: popularity.checkpoint_urls(raw, P),
    "funnel": lambda raw: journeys.checkpoint_funnel(raw, P),
    "bounces": lambda raw: journeys.bounces(raw, P),
    "forms": lambda raw: journeys.forms(raw, P),
    "bundles": lambda raw: journeys.bundles(raw, P.replace(startdate="2024-01-05")),
    "content": lambda raw: content_requests.content_requests(raw, DATES),
    "experiments": lambda raw: statistics.experiments(raw, P),
    "intervals": lambda raw: statistics.intervals(raw, P, intervals="2024-01-10,a,2024-01-20,b"),
    "correlation": lambda raw: statistics.vitals_correlation(raw, P),
    "score": lambda raw: score.experience_score(raw, P),
}
# bundles: heads, then the events of one page; content: requests, and two narrow columns for the usual collector
TWO_SCANS = {"bundles", "content"}


@pytest.mark.parametrize("name", list(REPORTS))
def test_plan(name, spark, monkeypatch):
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return writing.materialise(df)

    for module in (dashboard, journeys, popularity, score, statistics, content_requests, ordering):
        if hasattr(module, "materialise"):
            monkeypatch.setattr(module, "materialise", keep)
    df = REPORTS[name](views.rum(spark, SF_DIR))
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    text = "\n".join(plans)
    # reads of tables that the report has written itself don't count
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "/table-" not in line]
    assert len(scans) == (2 if name in TWO_SCANS else 1), scans
    assert all("PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in s for s in scans)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text
    assert "percentile_approx" not in text
