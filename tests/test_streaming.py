from datetime import datetime, timezone

import pytest
from pyspark.sql import types as T

from registry import settings as cfg
from sentinel.config import Span, Target, parse_time
from sentinel.operators import history, incidents
from sentinel.plans.watch import Watch
from sentinel.sources.event_logs import event_logs
from sentinel.streaming import jobs, state


def test_alerts_are_appended_once(spark, events, tmp_path):
    watch = Watch(event_logs(events), cfg.CALM, cfg.SPAN, written=True)
    found = watch.written_signals(heartbeats=False)
    documents = watch.documents(watch.alerts(found), found).cache()
    append = jobs.append_new_alerts(str(tmp_path / "alerts"))
    append(documents.where("ts < '2024-01-15'"), 0)
    append(documents.where("ts < '2024-01-15'"), 0)
    append(documents, 1)
    stored = spark.read.parquet(str(tmp_path / "alerts"))
    assert stored.count() == documents.count() > 0
    assert history.top_signal_kinds(stored).collect() == history.top_signal_kinds(documents).collect()


WINDOWS = "target STRING, signature STRING, w_end BIGINT, delivered BOOLEAN"
BASE = parse_time("2026-06-01T00:00:00Z")
DAY = 86400


def sent(spark, path, schema, files):
    """Rows as files of a stream, in this order."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, T._parse_datatype_string(schema), files_per_batch=1)


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2], [2, 3, 0, 1]])
def test_cooldown_does_not_depend_on_files_or_their_order(spark, tmp_path, order):
    state.use_state_store(spark)
    rows = [("a", f"s{k}", BASE + t, (k + t // 3600) % 7 != 0) for k in range(3) for t in range(0, 60 * 3600, 5 * 3600)]
    files = [[r for r in rows if (r[2] - BASE) // (15 * 3600) == i] for i in order]
    target = Target(name="a", cooldown_hours=12.0)
    clock = jobs.new_clock(spark)
    stream = state.cooldown(sent(spark, str(tmp_path / "in"), WINDOWS, files), [target], 5 * DAY, clock)
    out = jobs.run_to_table(stream, "cooldown-test", clock, BASE + 5 * DAY, 5 * DAY).collect()
    batch = incidents.cooldown(spark.createDataFrame(rows, WINDOWS), [target]).collect()
    found = sorted((r.signature, r.w_end, r.delivered, r.alerted) for r in out)
    assert found == sorted((r.signature, r.w_end, r.delivered, r.alerted) for r in batch) and len(found) == len(rows)


def test_first_seen_in_any_order_and_after_it_was_forgotten(spark, tmp_path):
    state.use_state_store(spark)
    kept = state.FirstSeenState.retention
    ends = {"x": [0, DAY, kept + DAY, 2 * kept + 2 * DAY], "y": [3 * DAY]}
    rows = [("a", fp, BASE + t) for fp, times in ends.items() for t in times]
    clock = jobs.new_clock(spark)
    files = [[rows[3]], [rows[1], rows[4]], [rows[2]], [rows[0]]]
    stream = state.first_seen(sent(spark, str(tmp_path / "in"), "target STRING, fp STRING, w_end BIGINT", files), 3 * kept, clock)
    out = jobs.run_to_table(stream, "seen-test", clock, BASE + 3 * kept, 3 * kept).collect()
    # DAY to kept + DAY is exactly the retention, the step after it is a day more
    assert sorted((r.fp, r.w_end - BASE) for r in out) == [("x", 0), ("x", 2 * kept + 2 * DAY), ("y", 3 * DAY)]


def test_counts_hold_the_newest_bucket_and_rows_that_come_late(spark, tmp_path):
    target = Target(name="a", window_hours=6.0, index_silent_window_hours=12.0)
    span = Span.replay("2026-06-01T00:00:00Z", "2026-06-03T00:00:00Z")
    hours = [40, 41, 3, 47, 0, 12]
    files = [[(datetime.fromtimestamp(BASE + h * 3600, timezone.utc).replace(tzinfo=None), "app", "Error")] * (i + 1) for i, h in enumerate(hours)]
    folders = [str(tmp_path / x) for x in ("counts", "checkpoint")]
    schema = "ts TIMESTAMP_NTZ, index_name STRING, level STRING"
    for upto in (3, 6):
        stream = sent(spark, str(tmp_path / "in"), schema, files[upto - 3: upto])
        found = jobs.run_bucket_counts(stream, [target], span, *folders).collect()
        expected = {}
        for i, h in enumerate(hours[:upto]):
            expected[BASE + h // 6 * 6 * 3600] = expected.get(BASE + h // 6 * 6 * 3600, 0) + i + 1
        assert {r.bucket: r.n for r in found} == expected


def test_a_batch_that_fails_after_its_write_is_not_counted_twice(spark, tmp_path):
    folders = [str(tmp_path / x) for x in ("out", "checkpoint")]
    stream = sent(spark, str(tmp_path / "in"), "x INT", [[(1,)], [(2,)], [(3,)]])
    sink = jobs.batch_sink(folders[0])

    def fails(batch, number):
        sink(batch, number)
        if number == 1:
            raise RuntimeError("after the write")

    with pytest.raises(Exception, match="after the write"):
        jobs.drain(stream, fails, folders[1])
    half = tmp_path / "out" / "batch=7"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half a file")  # no marker: not read
    jobs.drain(stream, sink, folders[1])
    schema = T._parse_datatype_string("x INT")
    assert sorted(r.x for r in jobs.read_batches(spark, folders[0], schema).collect()) == [1, 2, 3]
    assert jobs.read_batches(spark, folders[0], schema, below=1).count() == 1
    assert jobs.read_batches(spark, str(tmp_path / "nothing"), schema).count() == 0


def test_a_service_that_never_spoke_is_told_of(spark, tmp_path):
    state.use_state_store(spark)
    target = Target(name="a", indices=["*"], heartbeat_checks=["up=app=Heartbeat: up", "late=app=Heartbeat: late", "never=app=Heartbeat: never"],
                    heartbeat_max_staleness_minutes=30)
    at = lambda minutes: datetime.fromtimestamp(BASE + minutes * 60, timezone.utc).replace(tzinfo=None)
    files = [[(at(m), "app", "Heartbeat: up") for m in range(0, 60, 10)], [(at(70), "app", "Heartbeat: late"), (at(75), "app", "Heartbeat: up")]]
    clock = jobs.new_clock(spark)
    logs = jobs.with_clock(sent(spark, str(tmp_path / "in"), "ts TIMESTAMP_NTZ, index_name STRING, message STRING", files), clock)
    found = state.missing_heartbeats(jobs.heartbeat_minutes(logs, [target]), state.expected_services(spark, [target], BASE))
    rows = jobs.run_to_table(found, "heartbeat-test", clock, BASE + 104 * 60).collect()
    found = [(r.service, r.last_second and (r.last_second - BASE) // 60, (r.missing_since - BASE) // 60) for r in rows]
    assert sorted(found, key=str) == [("late", 70, 100), ("late", None, 30), ("never", None, 30)]
