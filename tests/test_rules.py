"""Thresholds and false positives of the detectors, on literal windows."""

import pytest

from sentinel.config import Span, Target, bucket_seconds, override, targets_from
from sentinel.operators import access, gate, hosts, silence
from sentinel.plans.watch import Watch

SPAN = Span.replay("2026-06-01T00:00:00Z", "2026-06-01T12:00:00Z")
END = SPAN.end


def kinds(rows):
    return sorted(r.kind for r in rows.collect())


@pytest.fixture
def gate_kinds(spark):
    def run(target=Target(), **values):
        names = [p + n for n in ("total", "err", "warn", "fatal", "ignored") for p in ("", "base_")]
        row = {"total": 100, "base_total": 100, **values}
        frame = spark.createDataFrame(
            [(target.name, END, *[row.get(n, 0) for n in names], 1)],
            "target STRING, w_end BIGINT, " + ", ".join(f"{n} BIGINT" for n in names)
            + ", n_templates BIGINT")
        return kinds(gate.gate_signals(frame, [target]))

    return run


@pytest.mark.parametrize("values,expected", [
    (dict(err=30, base_err=2), ["error_spike"]),
    (dict(err=3), []),
    (dict(err=1, base_err=1, fatal=1, base_fatal=1), ["fatal"]),
    (dict(warn=60, base_warn=5), ["warn_spike"]),
    (dict(warn=12), []),
    (dict(warn=47, ignored=44), []),
    (dict(warn=74, ignored=44), ["warn_spike"]),
    (dict(warn=30, base_warn=60, base_ignored=60), ["warn_spike"]),
    (dict(warn=5, ignored=9), []),
    (dict(total=0, base_total=500), ["ingestion_stopped"]),
    (dict(total=0, base_total=4), []),
    (dict(err=5), ["error_spike"]),
])
def test_gate(gate_kinds, values, expected):
    assert gate_kinds(**values) == expected


def test_gate_switches(gate_kinds):
    quiet = Target(alert_on_warn_spike=False, ingestion_drop_check=False)
    assert gate_kinds(quiet, warn=60, total=0, base_total=500) == []


def templates(spark, *rows):
    return spark.createDataFrame(
        [("default", END, base, message, n, i, ) for i, (base, message, n) in enumerate(rows)],
        "target STRING, w_end BIGINT, is_base BOOLEAN, message STRING, n BIGINT, rank INT")


def test_new_errors_need_a_new_fingerprint(spark):
    target = Target(warn_spike_ignore=["curl exited from 10.1.2.3"])
    rows = gate.scrubbed_windows(templates(
        spark, (False, "timeout after 30s", 3), (True, "timeout after 9s", 1),
        (False, "disk full", 2), (False, "curl exited from 10.1.2.3", 9)), [target])
    found = gate.new_error_signals(rows, [target]).collect()
    assert [(r.cur, r.extra) for r in found] == [(1, ["disk full"])]
    counts = gate.with_ignored(spark.createDataFrame([("default", END)], "target STRING, w_end BIGINT"),
                               rows).collect()[0]
    assert (counts.ignored, counts.base_ignored, counts.n_templates) == (9, 0, 3)


def test_scrub_collision_adds_up(spark):
    rows = gate.scrubbed_windows(
        templates(spark, (False, "user a@b.com failed", 3), (False, "user c@d.com failed", 2)),
        [Target()]).collect()
    assert [(r.message, r.n) for r in rows] == [("user <email> failed", 5)]


def silent(spark, *counts, **settings):
    """counts: (index, hour of the day the rows fall on, n) over two days."""
    target = Target(window_hours=24.0, **settings)
    span = Span.latest("2026-06-03T00:00:00Z")
    start = span.end - 48 * 3600
    rows = spark.createDataFrame(
        [(start + hour * 3600 // bucket_seconds([target]) * bucket_seconds([target]), name, "Error", n)
         for name, hour, n in counts], "bucket BIGINT, index_name STRING, level STRING, n BIGINT")
    return [(r.entity, r.base) for r in
            silence.index_silent_signals(rows, [target], span).collect()]


def test_index_silence(spark):
    assert silent(spark, ("a", 1, 50), ("b", 1, 50), ("b", 30, 10)) == [("a", 50)]
    assert silent(spark, ("a", 1, 50), ("b", 1, 50)) == [], "everything silent is another signal"
    assert silent(spark, ("a", 1, 3), ("b", 30, 10)) == []
    assert silent(spark, ("s-2026.05", 1, 50), ("s-2026.06", 30, 10)) == []
    assert silent(spark, (".ds-s-2026.05.01-000001", 1, 9), (".ds-s-2026.06.01-000002", 30, 9)) == []
    assert silent(spark, ("s-2026.05", 1, 30), ("s-2026.06", 2, 30), ("b", 30, 1)) == [("s", 60)]


def clients(spark, target=Target(), **values):
    names = ["total", "c4xx", "auth_fail", "scoped_fail", "distinct_paths"]
    frame = spark.createDataFrame(
        [("default", END, "1.2.3.4", *[values.get(n, 0) for n in names])],
        "target STRING, w_end BIGINT, source_ip STRING, "
        + ", ".join(f"{n} BIGINT" for n in names))
    return kinds(access.client_signals(frame, [target]))


def test_clients(spark):
    assert clients(spark, c4xx=120, distinct_paths=80) == ["api_scan"]
    assert clients(spark, c4xx=290, distinct_paths=2) == []
    assert clients(spark, auth_fail=360, scoped_fail=0) == []
    assert clients(spark, auth_fail=88, scoped_fail=88) == ["auth_bruteforce"]


def test_unscoped_rejections_count_without_a_prefix(spark, logs_of):
    rows = [{"ts": "2026-06-01T01:00:00", "status_code": 401, "url_path": f"/p{i % 2}",
             "source_ip": "9.9.9.9"} for i in range(55)]
    for prefix, expected in (("", ["auth_bruteforce"]), ("/api/auth", [])):
        watch = Watch(logs_of(rows), [Target(security_auth_path_prefix=prefix)], SPAN)
        found = access.client_signals(access.access_by_ip(watch.requests),
                                      watch.targets)
        assert kinds(found) == expected


def test_suspicious_requests(spark, logs_of):
    rows = [{"ts": "2026-06-01T01:00:00", "status_code": 404, "url_path": "/.env",
             "source_ip": None if i == 0 else "9.9.9.9"} for i in range(12)]
    rows += [{"ts": "2026-06-01T01:00:00", "status_code": 200, "url_path": "/.env"}] * 5
    watch = Watch(logs_of(rows), [Target()], SPAN)
    row = access.suspicious_requests(watch.requests).collect()[0]
    assert (row.suspicious, [tuple(p) for p in row.paths], [tuple(p) for p in row.ips]) == (
        12, [("/.env", 12)], [("9.9.9.9", 11)])
    few = Watch(logs_of(rows[:2]), [Target()], SPAN)
    assert kinds(access.suspicious_signals(access.suspicious_requests(few.requests), few.targets)) == []


def host_kinds(spark, **values):
    names = ["total", "base_total", "ssh_fail", "oom", "disk", "unit_fail"]
    frame = spark.createDataFrame(
        [("default", END, "vm1", *[values.get(n, 0) for n in names])],
        "target STRING, w_end BIGINT, host STRING, " + ", ".join(f"{n} BIGINT" for n in names))
    return kinds(hosts.host_signals(frame, [Target(linux_indices=["*"])]))


def test_hosts(spark):
    assert host_kinds(spark, total=99, ssh_fail=57) == ["linux_ssh_bruteforce"]
    assert host_kinds(spark, total=99, ssh_fail=19) == []
    assert host_kinds(spark, total=9, oom=1, disk=2) == ["linux_disk_errors", "linux_oom"]
    assert host_kinds(spark, total=9, unit_fail=9) == []
    assert host_kinds(spark, total=10, unit_fail=10) == ["linux_unit_failures"]
    assert host_kinds(spark, base_total=500) == ["linux_host_silent"]
    assert host_kinds(spark, base_total=3) == []


def test_heartbeats_per_service(spark, logs_of):
    target = Target(heartbeat_checks=["api=app-*=Heartbeat: api", "bot=app-*=Heartbeat: bot",
                                      "broken"], heartbeat_max_staleness_minutes=5)
    assert [h[0] for h in target.heartbeats] == ["api", "bot"]
    rows = [{"ts": "2026-06-01T05:56:00", "message": "Heartbeat: api"},
            {"ts": "2026-06-01T05:54:59", "message": "Heartbeat: bot"},
            {"ts": "2026-06-01T11:55:00", "message": "heartbeat bot"},
            {"ts": "2026-06-01T11:59:59", "message": "Heartbeat: apis"}]
    watch = Watch(logs_of(rows), [target], SPAN)
    found = silence.heartbeat_signals(watch.rows, [target], SPAN).collect()
    assert sorted((r.w_end - SPAN.start, r.entity) for r in found) == [
        (6 * 3600, "bot"), (12 * 3600, "api")]


def test_heartbeats_with_a_limit_longer_than_the_window(spark, logs_of):
    target = Target(heartbeat_checks=["api=app-*=Heartbeat: api"],
                    heartbeat_max_staleness_minutes=8 * 60)
    watch = Watch(logs_of([{"ts": "2026-06-01T04:30:00", "message": "Heartbeat: api"}]), [target], SPAN)
    counts = silence.heartbeat_counts(watch.rows, [target], SPAN).collect()
    assert sorted((r.w_end - SPAN.start, r.hits) for r in counts) == [(21600, 1), (43200, 1)]


def test_settings():
    targets = targets_from({"defaults": {"min_errors": 9, "indices": "a-*, b"},
                            "targets": [{"name": "x"}, {"name": "y", "min_errors": 1,
                                                        "warn_spike_ignore": None, "smtp_port": 1}]})
    assert [(t.name, t.min_errors, t.indices) for t in targets] == [
        ("x", 9, ["a-*", "b"]), ("y", 1, ["a-*", "b"])]
    with pytest.raises(ValueError):
        override(Target(), {"indices": 3})
    with pytest.raises(ValueError, match="nope"):
        override(Target(), {"nope": 1})
    assert override(Target(), {"es_indices": "a-*,b"}).indices == ["a-*", "b"]
    with pytest.raises(ValueError):
        targets_from({"targets": [{"name": "x"}, {"name": "x"}]})


def test_replay_grid():
    span = Span.replay("2026-06-01T00:00:00Z", "2026-06-01T18:30:00Z")
    assert [(e - span.start) // 3600 for e in
            range(span.first_end(21600), span.last_end(21600) + 1, 21600)] == [6, 12, 18]
    assert bucket_seconds([Target(), Target(window_hours=4.0)]) == 7200


def test_detectors_see_rare_templates_and_quiet_clients(spark, logs_of):
    """A new error behind fifteen louder ones, and a scanner behind twenty busier clients."""
    rows = [{"ts": f"2026-06-01T0{h}:00:00", "level": "Error", "message": f"loud error {chr(97 + i)}"}
            for i in range(15) for h in (1, 7) for _ in range(9)]
    rows += [{"ts": "2026-06-01T08:00:00", "level": "Error", "message": "brand new"}] * 2
    rows += [{"ts": "2026-06-01T08:00:00", "status_code": 200, "url_path": "/", "source_ip": f"10.0.0.{i}"}
             for i in range(20) for _ in range(90)]
    rows += [{"ts": "2026-06-01T08:00:00", "status_code": 404, "url_path": f"/p{i}", "source_ip": "9.9.9.9"} for i in range(60)]
    watch = Watch(logs_of(rows), [Target()], SPAN)
    found = gate.new_error_signals(watch.templates, watch.targets).where(f"w_end = {END}").collect()
    assert [(r.cur, r.extra) for r in found] == [(1, ["brand new"])]
    clients_ = access.access_by_ip(watch.requests)
    assert [r.entity for r in access.client_signals(clients_, watch.targets).collect()] == ["9.9.9.9"]
    assert access.busiest_clients(clients_, [Target(security_top_ips=20)]).count() == 20


def test_windows_and_silence_of_mixed_targets(spark, logs_of):
    """One target's result doesn't depend on the others it runs with, whatever their steps."""
    rows = [{"ts": f"2026-05-3{d}T{h:02d}:30:00", "index_name": name, "level": "Error", "message": "x"}
            for d in (0, 1) for h in range(24) for name in ("a", "b") if (d, name) != (1, "a")]
    mixed = [Target(name="day", min_errors=1), Target(name="hour", window_hours=1.0, ingestion_drop_check=False)]
    span = Span.replay("2026-05-31T00:00:00Z", "2026-06-01T00:00:00Z")

    def found(targets):
        watch = Watch(logs_of(rows), targets, span)
        return sorted((r.entity, r.w_end, r.cur, r.base) for r in silence.index_silent_signals(
            watch.counts, targets, span, watch.step).collect())

    assert found(mixed) == found(mixed[:1]) != []


def test_digest_of_windows_that_do_not_divide_the_day(spark, logs_of):
    from sentinel.operators import history

    rows = [{"ts": f"2026-06-0{d}T{h:02d}:30:00", "level": "Error", "message": "x"} for d in (1, 2) for h in range(24)]
    targets = [Target(window_hours=5.0, ingestion_drop_check=False)]
    span = Span.replay("2026-06-01T00:00:00Z", "2026-06-03T00:00:00Z")
    none = spark.createDataFrame([], "target STRING, w_end BIGINT")
    with pytest.raises(ValueError):
        watch = Watch(logs_of(rows), targets, span)
        history.digest(watch.counts, watch.messages, none, targets, span, 1, watch.step)
    watch = Watch(logs_of(rows), targets, span, periods=(86400,))
    days = history.digest(watch.counts, watch.messages, none, targets, span, 1, watch.step).collect()
    assert sorted(r.total for r in days) == [24, 24]
