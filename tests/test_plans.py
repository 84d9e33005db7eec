"""Plan shapes, and results that may not depend on how the work is cut."""

import re

import pytest

from registry import settings as cfg
from registry.queries import QUERIES
from sentinel.config import Span, Target
from sentinel.plans.watch import Watch
from sentinel.sources.event_logs import event_logs
from sentinel.sources.logs import conform


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["error_spike", "access_by_ip", "host_counts", "top_messages",
                                  "index_silent", "error_samples", "suspicious_requests"])
def test_one_scan_and_no_python(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert len(re.findall("FileScan|Scan parquet", text)) == 1
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_time_bounds_and_columns_reach_the_scan(spark, folder):
    text = plan(QUERIES["window_totals"](spark, folder))
    assert re.search(r"PushedFilters: \[IsNotNull\(ts\)", text)
    assert "value" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_top_k_trims_before_the_shuffle(spark, folder):
    for name in ("top_messages", "error_samples", "new_errors"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, folder))


def rows(frame):
    return sorted(tuple(str(v) for v in r) for r in frame.collect())


def test_targets_together_or_apart(spark, events):
    logs = event_logs(events)
    together = rows(Watch(logs, cfg.MULTI, cfg.SPAN).signals())
    apart = sorted(r for t in cfg.MULTI for r in rows(Watch(logs, [t], cfg.SPAN).signals()))
    assert together and together == apart


def test_written_facts_change_nothing(spark, events):
    logs = event_logs(events)
    assert rows(Watch(logs, cfg.MAIN, cfg.SPAN, written=True).signals()) == rows(
        Watch(logs, cfg.MAIN, cfg.SPAN).signals())


def test_redaction_before_the_first_sum_changes_nothing(spark, events):
    logs = event_logs(events)
    for written in (True, False):
        early = Watch(logs, cfg.MULTI, cfg.SPAN, written=written)
        late = Watch(logs, cfg.MULTI, cfg.SPAN, written=written, raw_templates=True)
        assert early.redacted and not late.redacted
        assert rows(early.templates) == rows(late.templates)
        assert rows(early.messages.groupBy("message").sum("n")) == rows(late.messages.groupBy("message").sum("n"))


def test_facts_do_not_grow_with_the_clients_that_lines_name(spark):
    from dataclasses import replace

    logs = conform(spark.range(20_000, numPartitions=4).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2026-06-01 01:00:00' AS ts", "'app-logs' AS index_name", "'Error' AS level",
        "concat('login of u', id, '@example.org refused') AS message"), {"message_template": "message"})
    span, target = Span.replay("2026-06-01T00:00:00Z", "2026-06-01T06:00:00Z"), Target()
    assert Watch(logs, [target], span, written=True).lines.count() == 1
    # one target that keeps raw texts, or ranks them, keeps them raw in the facts of all
    for other in (replace(target, name="raw", scrub_pii=False), replace(target, name="listed", template_limit=3)):
        watch = Watch(logs, [target, other], span, written=True)
        assert not watch.redacted and watch.lines.count() == 20_000


def test_latest_window_equals_its_replay(spark, events):
    logs = event_logs(events)
    end = cfg.SPAN.start + 80 * 21600
    latest = rows(Watch(logs, cfg.MAIN, Span(end, None, end)).signals())
    replayed = Watch(logs, cfg.MAIN, cfg.SPAN).signals().where(f"w_end = {end}")
    assert latest and latest == rows(replayed)


def test_one_hot_key_is_counted_whole(spark):
    """One client, path, host and message hold almost all rows."""
    logs = conform(spark.range(200_000, numPartitions=8).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2026-06-01 01:00:00' AS ts", "'app-logs' AS index_name",
        "'Error' AS level", "if(id % 1000 = 0, concat('rare ', id), 'Failed password') AS message",
        "if(id % 1000 = 0, concat('h', id), 'hot') AS host", "404 AS status_code",
        "if(id % 1000 = 0, concat('/p', id), '/hot') AS url_path", "'1.1.1.1' AS source_ip"),
        {"message_template": "message"})
    target = Target(linux_indices=["*"])
    watch = Watch(logs, [target], Span.replay("2026-06-01T00:00:00Z", "2026-06-01T06:00:00Z"))
    from sentinel.operators import access, gate

    client = access.access_by_ip(watch.requests).collect()[0]
    assert (client.total, client.c4xx, client.distinct_paths) == (200_000, 200_000, 201)
    hot = {r.host: r for r in watch.host_windows.collect()}["hot"]
    assert (hot.total, hot.ssh_fail) == (199_800, 199_800)
    top = gate.top_messages(watch.messages, [target], watch.span).collect()
    assert len(top) == 15 and max(r.n for r in top) == 199_800


def test_missing_fields_degrade(spark):
    logs = conform(spark.createDataFrame([("x", 1)], "index_name STRING, event_id BIGINT").selectExpr(
        "*", "TIMESTAMP_NTZ'2026-06-01 01:00:00' AS ts"))
    watch = Watch(logs, [Target()], Span.replay("2026-06-01T00:00:00Z", "2026-06-01T06:00:00Z"))
    assert [(r.total, r.err) for r in watch.window_counts.collect()] == [(1, 0)]
    assert watch.signals().count() == 0


def test_unaligned_baseline(spark, logs_of):
    """A 5 h window against the same window yesterday: no window of the grid is the baseline."""
    target = Target(window_hours=5.0, baseline_mode="yesterday")
    span = Span.replay("2026-06-02T00:00:00Z", "2026-06-02T05:00:00Z")
    logs = logs_of([{"ts": f"2026-06-{d:02d}T0{h}:30:00", "level": "Error", "message": f"m{d}{h}"}
                    for d in (1, 2) for h in range(9)])
    watch = Watch(logs, [target], span)
    (row,) = watch.window_counts.collect()
    assert (row.err, row.base_err) == (5, 5)
    assert sorted((r.is_base, r.message) for r in watch.templates.collect()) == sorted(
        (d == 1, f"m{d}{h}") for d in (1, 2) for h in range(5))
