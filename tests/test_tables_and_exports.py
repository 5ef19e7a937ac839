from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagetally.operators import scan
from pagetally.operators.access import key_digest
from pagetally.params import ReportParams
from pagetally.plans import request_log, table_jobs
from pagetally.sources import export, files, snapshots

P = ReportParams(as_of=datetime(2024, 2, 1), interval=31, domainkey="admin")


@pytest.fixture
def keys(spark, tmp_path):
    rows = spark.createDataFrame(
        [("", "admin", None, False), ("", "reader", None, True), ("a.com", "a", None, False), ("b.com", "b", date(2024, 1, 1), True)],
        "hostname_prefix string, secret string, revoke_date date, readonly boolean",
    ).select(
        "hostname_prefix", key_digest(F.col("secret")).alias("key_bytes"), "revoke_date", "readonly",
        F.lit(date(2023, 1, 1)).alias("create_date"), F.lit(None).cast("string").alias("parent_key_bytes"), F.lit("").alias("note"),
    )
    path = str(tmp_path / "keys")
    snapshots.write(rows, path)
    return path


def key_table(spark, path):
    rows = snapshots.read(spark, path, files.KEY_SCHEMA).collect()
    return sorted((r.hostname_prefix, r.revoke_date, r.readonly) for r in rows if r.revoke_date), rows


def test_rotation_expires_old_and_issues_new_keys(spark, keys):
    p = P.replace(url="a.com, b.com,")
    row = table_jobs.rotate_keys(spark, keys, p, "fresh", grace_days=7, expiry="2024-12-31", note="n").first()
    assert tuple(row) == ("fresh", "a.com, b.com,", "success", "2024-12-31")
    dated, rows = key_table(spark, keys)
    assert dated == [
        ("a.com", date(2024, 2, 8), False), ("a.com", date(2024, 12, 31), True), ("b.com", date(2024, 1, 1), True),
        ("b.com", date(2024, 12, 31), True),
    ]
    new = [r for r in rows if r.note == "n"]
    assert len(new) == 2 and len({r.key_bytes for r in new}) == 1 and new[0].create_date == date(2024, 2, 1)


def test_rotation_needs_a_read_write_key(spark, keys):
    for secret in ("reader", "a", "nobody"):
        table_jobs.rotate_keys(spark, keys, P.replace(domainkey=secret, url="b.com"), "fresh", grace_days=7)
    assert len(key_table(spark, keys)[1]) == 4
    made = table_jobs.rotate_keys(spark, keys, P.replace(domainkey="a", url="a.com")).first()
    assert made.status == "success" and len(made.key) == 36


def test_revoking_ends_one_key(spark, keys):
    row = table_jobs.revoke_key(spark, keys, P.replace(url="a.com"), "a", grace_days=0).first()
    assert tuple(row) == ("a", "a.com", "success")
    assert ("a.com", date(2024, 2, 1), False) in key_table(spark, keys)[0]
    assert table_jobs.revoke_key(spark, keys, P.replace(url="a.com", domainkey="reader"), "a").first().status == "failure"


def test_a_lost_job_blocks_nobody(spark, keys):
    Path(keys, "rows-of-a-lost-job").mkdir()
    base = snapshots.newest(spark, keys)
    table = snapshots.read(spark, keys, files.KEY_SCHEMA, base)
    assert table.count() == 4
    snapshots.write(table.limit(3), keys, base)
    assert snapshots.newest(spark, keys) == base + 1
    assert snapshots.read(spark, keys, files.KEY_SCHEMA).count() == 3


@pytest.mark.parametrize("step", ["_noted", "_publish", "_expire"])
def test_a_job_may_die_at_any_step(spark, keys, monkeypatch, step):
    base = snapshots.newest(spark, keys)
    table = snapshots.read(spark, keys, files.KEY_SCHEMA, base)

    def dies(*_):
        raise KeyboardInterrupt(step)

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, step, dies)
        with pytest.raises(KeyboardInterrupt):
            snapshots.write(table.limit(1), keys, base)
    done = step == "_expire"
    assert snapshots.newest(spark, keys) == base + done
    assert snapshots.read(spark, keys, files.KEY_SCHEMA).count() == (1 if done else 4)
    snapshots.write(table.limit(3), keys, base + done)
    assert snapshots.read(spark, keys, files.KEY_SCHEMA).count() == 3
    left = {"_noted": 1, "_publish": 2, "_expire": 0}[step]
    assert snapshots.tidy(spark, keys) == [] and len(snapshots.tidy(spark, keys, -60)) == left
    assert snapshots.read(spark, keys, files.KEY_SCHEMA).count() == 3


def test_an_empty_marker_publishes_nothing_and_locks_nothing(spark, keys):
    base = snapshots.newest(spark, keys)
    Path(keys, f"snapshot={base + 1:08d}").touch()
    table = snapshots.read(spark, keys, files.KEY_SCHEMA)
    assert table.count() == 4 and snapshots.newest(spark, keys) == base
    snapshots.write(table.limit(2), keys, base)
    assert snapshots.newest(spark, keys) == base + 2 and snapshots.read(spark, keys, files.KEY_SCHEMA).count() == 2
    with pytest.raises(RuntimeError, match="another job"):
        snapshots.write(table.limit(1), keys, base)


def test_of_many_jobs_at_once_one_publishes(spark, keys):
    base = snapshots.newest(spark, keys)
    table = snapshots.read(spark, keys, files.KEY_SCHEMA, base)

    def job(n):
        try:
            snapshots.write(table.limit(n), keys, base)
        except RuntimeError:
            return None
        return n

    with ThreadPoolExecutor(4) as pool:
        won = [n for n in pool.map(job, (1, 2, 3, 4)) if n is not None]
    assert len(won) == 1 and snapshots.newest(spark, keys) == base + 1
    assert snapshots.read(spark, keys, files.KEY_SCHEMA).count() == won[0]


def test_of_two_jobs_on_one_base_the_later_fails(spark, keys):
    base = snapshots.newest(spark, keys)
    first, second = (snapshots.read(spark, keys, files.KEY_SCHEMA, base) for _ in range(2))
    snapshots.write(first.limit(2), keys, base)
    with pytest.raises(RuntimeError, match="another job"):
        snapshots.write(second.limit(1), keys, base)
    assert snapshots.read(spark, keys, files.KEY_SCHEMA).count() == 2


def test_old_snapshots_go(spark, keys, monkeypatch):
    monkeypatch.setattr(snapshots, "KEPT", 2)
    for _ in range(4):
        base = snapshots.newest(spark, keys)
        snapshots.write(snapshots.read(spark, keys, files.KEY_SCHEMA, base), keys, base)
    assert snapshots._published(spark, keys) == [3, 4]
    assert len(list(Path(keys).glob("rows-*"))) == 2


def test_two_changes_for_one_domain_are_refused(spark):
    schema = table_jobs.DOMAIN_SCHEMA
    info, changes = spark.createDataFrame([("a.com", "1")], schema), spark.createDataFrame([("a.com", "2"), ("a.com", "3")], schema)
    with pytest.raises(Exception, match="two changes for the domain a.com"):
        table_jobs.upserted(info, changes).collect()


def test_upsert_updates_and_adds(spark, keys, tmp_path):
    path = str(tmp_path / "domains")
    snapshots.write(spark.createDataFrame([("a.com", "1"), ("b.com", "2")], table_jobs.DOMAIN_SCHEMA), path)
    changes = spark.createDataFrame([("b.com", "9"), ("c.com", "3")], table_jobs.DOMAIN_SCHEMA)
    table = snapshots.read(spark, keys, files.KEY_SCHEMA)
    same = table_jobs.update_domain_info(spark, path, table, P.replace(domainkey="a", url="a.com"), changes)
    assert {r.domain: r.ims_org_id for r in same.collect()} == {"a.com": "1", "b.com": "2"}
    made = table_jobs.update_domain_info(spark, path, table, P, changes)
    assert {r.domain: r.ims_org_id for r in made.collect()} == {"a.com": "1", "b.com": "9", "c.com": "3"}


def test_audits_are_appended_for_the_key_s_own_url(spark, keys, tmp_path):
    table, path = snapshots.read(spark, keys, files.KEY_SCHEMA), str(tmp_path / "audits")
    scores = [0.5] * len(table_jobs.AUDIT_SCORES)
    batch = spark.createDataFrame(
        [(u, *scores, "mobile", "2024-01-01", "r") for u in ("a.com", "z.com")], table_jobs.AUDIT_SCHEMA
    )
    for _ in range(2):
        # a batch that is sent again is stored once
        made = table_jobs.add_audits(spark, path, table, P.replace(domainkey="a"), batch)
        assert [(r.url, r.number_of_row_instances) for r in made.collect()] == [("a.com", 1)]
    # the same row in another batch, and twice in it, is not the same batch
    row = batch.filter("url = 'a.com'")
    made = table_jobs.add_audits(spark, path, table, P.replace(domainkey="a"), row.union(row))
    assert [(r.url, r.number_of_row_instances) for r in made.collect()] == [("a.com", 3)]


def test_batches_are_told_apart_by_their_rows(spark):
    def name(*rows):
        return table_jobs.batch_name(spark.createDataFrame(rows, "a double, b double, c string").repartition(2))

    rows = [(0.5, None, "x"), (None, 0.5, "x"), (None, None, None)]
    assert name(*rows) == name(*reversed(rows))
    names = [name(*rows), name(rows[0]), name(rows[1]), name(rows[0], rows[0]), name(rows[0], rows[1]), name(rows[2]), name(rows[2], rows[2])]
    assert len(set(names)) == len(names)


def test_audits_are_read_back_by_partition(spark, keys, tmp_path):
    table, path = snapshots.read(spark, keys, files.KEY_SCHEMA), str(tmp_path / "audits")
    scores = [0.5] * len(table_jobs.AUDIT_SCORES)
    for ref in ("r1", "r2", "r3", None):
        batch = spark.createDataFrame([("a.com", *scores, "mobile", "2024-01-01", ref)], table_jobs.AUDIT_SCHEMA)
        made = table_jobs.add_audits(spark, path, table, P.replace(domainkey="a"), batch).collect()
        # a row without a reference is stored, but no reference finds it
        assert [(r.audit_ref, r.number_of_row_instances) for r in made] == ([(ref, 1)] if ref else [])
    one = table_jobs.stored_audits(spark, path, ["r2"])
    assert [r.audit_ref for r in one.collect()] == ["r2"]
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numPartitions").get().value() == 1
    assert table_jobs.stored_audits(spark, path).count() == 4


# ---- files


def test_events_are_read_from_both_collectors_and_pruned(spark, make_events, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    files.write_events(make_events({"id": "1", "time": "2024-01-02"}, {"id": "2", "time": "2024-01-20"}), one)
    files.write_events(make_events({"id": "3", "time": "2024-01-20"}).drop("generation"), two)
    raw = files.read_events(spark, one, two)
    ev = scan.events(raw, P.replace(interval=14, domainkey=None))
    assert sorted(r.id for r in ev.collect()) == ["2", "3"]
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(time)" in plan


def test_days_are_those_of_utc_whatever_the_session_s_zone(spark, make_events, tmp_path):
    rows = make_events({"id": "1", "time": "2024-01-02 23:30:00"}, {"id": "2", "time": "2024-01-03 00:30:00"}, {"id": "3", "time": "1969-12-31 23:00:00"})
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        files.write_events(rows, str(tmp_path / "ev"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    stored = files.read_events(spark, str(tmp_path / "ev"))
    assert {r.id: str(r.event_date) for r in stored.collect()} == {"1": "2024-01-02", "2": "2024-01-03", "3": "1969-12-31"}


def test_days_of_another_table_prune_partitions(spark, make_events, tmp_path):
    files.write_events(make_events(*[{"id": str(d), "time": f"2024-01-{d:02d}"} for d in range(1, 21)]), str(tmp_path / "ev"))
    raw = files.read_events(spark, str(tmp_path / "ev"))
    days = spark.createDataFrame([(date(2024, 1, 3),), (date(2024, 1, 7),), (date(2025, 1, 1),), (None,)], "d date")
    days.write.parquet(str(tmp_path / "days"))
    found = scan.on_days(raw, spark.read.parquet(str(tmp_path / "days")), "d")
    assert sorted(r.id for r in found.collect()) == ["3", "7"]
    plan = found._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    leaves = plan.finalPhysicalPlan().collectLeaves()
    read = [leaves.apply(i).metrics().get("numPartitions").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numPartitions")]
    assert 2 in read and 20 not in read


def test_request_log_is_pruned_by_month(spark, tmp_path):
    log = spark.createDataFrame(
        [("o", "r", "main", "/p", "https://h.com/", "/p", "text/html; charset=utf-8", "200", str(1706000000000000 + i), m)
         for i, m in enumerate(["202401", "202401", "202312"])],
        "req_http_x_owner string, req_http_x_repo string, req_http_x_ref string, req_http_x_url string, req_http_referer string,"
        " req_url string, resp_http_content_type string, status_code string, time_start_usec string, month string",
    )
    log.write.partitionBy("month").parquet(str(tmp_path / "log"))
    stored = files.read_requests(spark, str(tmp_path / "log"))
    urls = request_log.dev_urls(stored, P.replace(as_of=datetime(2024, 1, 31)), "o", "r")
    assert [(r.req_url, r.requests) for r in urls.collect()] == [("/p", 2)]
    assert "month#" in urls._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    hosts = request_log.guess_hostname(stored, P.replace(as_of=datetime(2024, 1, 31)))
    assert [(r.host, r.requests) for r in hosts.collect()] == [("h.com", 3)]
    late = request_log.guess_hostname(stored, P.replace(as_of=datetime(2024, 1, 31), interval=10))
    assert [(r.host, r.requests) for r in late.collect()] == [("h.com", 2)]
    assert request_log.guess_hostname(stored, P.replace(as_of=datetime(2024, 1, 31), url="x.com")).count() == 0


# ---- exports


def test_csv_text(spark, tmp_path):
    rows = spark.createDataFrame(
        [("string", True, 1.0), ("str,ong", False, -0.1), ('str"ong', False, -0.1)], "string string, bool boolean, num double"
    ).coalesce(1)
    export.write_csv(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == 'string,bool,num\n"string",TRUE,1\n"str,ong",FALSE,-0.1\n"str""ong",FALSE,-0.1\n'
    # evaluated once
    runs = spark.sparkContext.accumulator(0)
    counted = rows.repartition(2).mapInArrow(lambda batches: (runs.add(b.num_rows) or b for b in batches), rows.schema)
    export.write_csv(counted, str(tmp_path / "once"))
    names = sorted(p.name for p in (tmp_path / "once").glob("part-*"))
    assert runs.value == 3 and (tmp_path / "once" / names[0]).read_text() == "string,bool,num\n"
    export.write_csv(rows.limit(0), str(tmp_path / "empty"))
    assert "".join(p.read_text() for p in (tmp_path / "empty").glob("part-*")) == ""


@pytest.mark.parametrize("number, text", [
    (12345678.9, "12345678.9"), (0.0001, "0.0001"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (1e-7, "1e-7"), (-3.0, "-3"),
    (123456789012345680.0, "123456789012345680"), (None, "null"), (0.1 + 0.2, "0.30000000000000004"),
])
def test_csv_numbers(spark, number, text):
    rows = spark.createDataFrame([(number,)], "n double")
    assert export.csv_lines(rows).first().line == text


def test_sheet(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "name string, views long")
    request = {"limit": 30, "url": "-", "domainkey": "secret"}
    export.write_sheet(rows, str(tmp_path / "sheet"), 30, "what it is", request, {"views": "page views"})

    def lines(part):
        return [json.loads(line) for p in sorted((tmp_path / "sheet" / part).glob("part-*")) for line in p.read_text().splitlines()]

    assert lines("results") == [{"name": "a", "views": 1}, {"name": "b", "views": None}]
    meta = {r["name"]: (r["value"], r["type"]) for r in lines("meta")}
    assert meta == {
        "description": ("what it is", "query description"), "limit": ("30", "request parameter"),
        "url": ("-", "request parameter"), "views": ("page views", "response detail"),
    }
    frame = {r["name"]: r for r in lines("frame")}
    assert (frame["results"]["limit"], frame["results"]["total"], frame["results"]["columns"]) == (30, 2, ["name", "views"])
