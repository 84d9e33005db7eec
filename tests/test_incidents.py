import hashlib
import time

import pytest

from sentinel.config import Target
from sentinel.operators import history, incidents


def signals(spark, *rows):
    return spark.createDataFrame(
        [("default", w_end, kind, severity, detail) for w_end, kind, severity, detail in rows],
        "target STRING, w_end BIGINT, kind STRING, severity STRING, detail STRING")


@pytest.fixture
def signature(spark):
    def run(kind, detail):
        frame = signals(spark, (0, kind, "medium", detail))
        return incidents.incidents(frame, [Target()]).collect()[0].signature

    return run


def test_signature_is_stable_and_distinct(signature):
    spike = "{} Fehler im Fenster (Vorfenster: {}, Schwelle Faktor 3.0)."
    assert signature("error_spike", spike.format(30, 4)) == signature("error_spike", spike.format(99, 7))
    assert signature("error_spike", "30 Fehler") != signature("warn_spike", "30 Fehler")
    for a, b in [("Host 'vm-01' schweigt", "Host 'vm-02' schweigt"),
                 ("Index 'logs-2': 0 Logs", "Index 'logs-3': 0 Logs"),
                 ("IP 45.9.1.2: 3 x", "IP 203.0.113.7: 3 x"),
                 ("IP 2001:db8::42: 3 x", "IP 2001:db8::99: 3 x")]:
        assert signature("k", a) != signature("k", b)


def test_details_are_redacted_after_the_signature(spark):
    frame = signals(spark, (0, "auth_bruteforce", "high", "IP 45.9.1.2: 30"), (0, "fatal", "high", "1"))
    targets = [Target()]
    row = incidents.verdict(incidents.with_signals(incidents.incidents(frame, targets), frame, targets)).collect()[0]
    assert [(s.kind, s.detail) for s in row.signals] == [("fatal", "1"), ("auth_bruteforce", "IP <ip>: 30")]
    assert row.forced and row.severity == "high" and row.anomalous


def test_very_many_signals_of_one_window(spark):
    """A window's signals stream past in order; next to it lie windows of one signal each."""
    count = 200_000
    hot = spark.range(count).selectExpr("'default' AS target", "7L AS w_end", "if(id = 5, 'fatal', 'api_scan') AS kind",
                                        "if(id = 5, 'high', 'medium') AS severity", "concat('client c', id) AS detail")
    small = spark.range(50).selectExpr("'default'", "100 + id", "'warn_spike'", "'low'", "concat('w', id)")
    out = {r.w_end: r for r in incidents.incidents(hot.union(small), [Target()]).collect()}
    parts = sorted(f"{'fatal' if i == 5 else 'api_scan'}:client c{i}" for i in range(count))
    assert out[7].signature == hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]
    assert len(out) == 51 and out[7].rule_severity == "high" and out[7].forced and not out[100].forced
    assert out[149].signature == hashlib.sha256(b"warn_spike:w49").hexdigest()[:16]


def test_signatures_of_missing_texts_and_of_no_signals(spark):
    frame = signals(spark, (0, "fatal", "high", None), (0, "fatal", "high", "x"), (1, "fatal", None, None))
    out = {r.w_end: r for r in incidents.incidents(frame, [Target()]).collect()}
    assert out[0].signature == hashlib.sha256(b"fatal:x").hexdigest()[:16]
    assert out[1].signature == hashlib.sha256(b"").hexdigest()[:16] and out[1].rule_severity is None
    assert incidents.incidents(frame.where("false"), [Target()]).count() == 0


def test_external_verdicts_need_the_signals(spark):
    rows = incidents.incidents(signals(spark, (0, "fatal", "high", "x")), [Target()]).selectExpr("*", "true AS ext_anomalous")
    with pytest.raises(ValueError, match="with_signals"):
        incidents.verdict(rows)


def test_external_verdict_cannot_talk_down_forced_kinds(spark):
    frame = signals(spark, (0, "api_scan", "high", "scan"), (1, "warn_spike", "low", "warn"))
    rows = incidents.with_signals(incidents.incidents(frame, [Target()]), frame, [Target()]).selectExpr(
        "*", "false AS ext_anomalous", "'low' AS ext_severity", "'' AS ext_summary",
        "'c' AS ext_cause", "'a' AS ext_action")
    out = {r.w_end: r for r in incidents.verdict(rows).collect()}
    assert out[0].anomalous and out[0].severity == "high" and out[0].summary.endswith("scan")
    assert not out[1].anomalous and out[1].severity == "low" and out[1].external_verdict


def decide(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "target STRING, signature STRING, w_end BIGINT,"
                                        " delivered BOOLEAN")
    out = incidents.cooldown(frame, [Target(name=n, **settings) for n in ("a", "b")])
    return {(r.target, r.signature, r.w_end): r.alerted for r in out.collect()}


def test_cooldown(spark):
    hour = 1.0
    found = decide(spark, [("a", "s", t, True) for t in (1000, 1500, 4599, 4600, 5000)]
                   + [("b", "s", 1100, True), ("a", "other", 1200, True)], cooldown_hours=hour)
    assert [found["a", "s", t] for t in (1000, 1500, 4599, 4600, 5000)] == [
        True, False, False, True, False]
    assert found["b", "s", 1100] and found["a", "other", 1200]


def test_undelivered_alerts_start_no_pause(spark):
    found = decide(spark, [("a", "s", 0, False), ("a", "s", 10, False), ("a", "s", 20, True),
                           ("a", "s", 30, True)], cooldown_hours=1.0)
    assert [found["a", "s", t] for t in (0, 10, 20, 30)] == [True, True, True, False]


def test_verdict_asof(spark):
    rows = spark.createDataFrame([("default", "s", t) for t in (5, 10, 3609, 3610)],
                                 "target STRING, signature STRING, w_end BIGINT")
    stored = spark.createDataFrame([("default", "s", 10, "low"), ("default", "x", 3000, "high")],
                                   "target STRING, signature STRING, ts BIGINT, ext_severity STRING")
    out = incidents.verdict_asof(rows, stored, [Target(verdict_ttl_hours=1.0)]).collect()
    assert sorted((r.w_end, r.verdict_ts) for r in out) == [(5, None), (10, 10), (3609, 10), (3610, None)]


def test_quota_starts_again_each_day(spark):
    rows = spark.createDataFrame([("default", t) for t in (0, 10, 20, 86400)],
                                 "target STRING, w_end BIGINT")
    out = incidents.daily_quota(rows, [Target(assessments_per_day=2)]).collect()
    assert sorted((r.w_end, r.within_budget, r.remaining) for r in out) == [
        (0, True, 1), (10, True, 0), (20, False, 0), (86400, True, 1)]


def test_seen_table_forgets(spark):
    day = 86400
    known = spark.createDataFrame([("a", "old", 0), ("a", "kept", 20 * day)],
                                  "target STRING, fp STRING, last_seen BIGINT")
    batch = spark.createDataFrame([("a", "new", 200 * day)], "target STRING, fp STRING, w_end BIGINT")
    out = history.merge_seen(known, batch, 200 * day).collect()
    assert sorted((r.fp, r.last_seen) for r in out) == [("kept", 20 * day), ("new", 200 * day)]


def test_cooldown_of_very_many_windows_of_one_signature(spark):
    """Linear in the windows: 100,000 of one signature, a third of them not delivered."""
    count, hour = 100_000, 3600
    frame = spark.range(count).selectExpr("'a' AS target", "'s' AS signature", f"id * {hour} AS w_end", "id % 3 <> 0 AS delivered")
    started = time.monotonic()
    out = {r.w_end // hour: (r.alerted, r.asked) for r in incidents.cooldown(
        frame, [Target(name="a", cooldown_hours=5.0, verdict_ttl_hours=8.0)]).select("w_end", "alerted", "asked").collect()}
    assert time.monotonic() - started < 60
    last, asked = None, None
    for i in range(count):
        fires = last is None or i - last >= 5
        asks = fires and (asked is None or i - asked >= 8)
        assert out[i] == (fires, asks)
        last, asked = (i if fires and i % 3 else last), (i if asks else asked)


def test_budget_of_a_day_over_all_targets(spark):
    day = 86400
    ends = [("a", day + 10), ("b", day + 10), ("a", day + 20), ("b", day + 30), ("a", 2 * day), ("b", 2 * day - 1)]
    rows = spark.createDataFrame([(t, f"s{e}", e) for t, e in ends], "target STRING, signature STRING, w_end BIGINT")
    targets = [Target(name="a", assessments_per_day=3), Target(name="b", assessments_per_day=1)]
    found = {(r.target, r.w_end): (r.nth, r.within_budget, r.remaining) for r in incidents.daily_quota(rows, targets).collect()}
    assert found == {("a", day + 10): (1, True, 2), ("b", day + 10): (2, False, 0), ("a", day + 20): (3, True, 0),
                     ("b", day + 30): (4, False, 0), ("b", 2 * day - 1): (5, False, 0), ("a", 2 * day): (1, True, 2)}


def test_a_row_beyond_the_budget_falls_back_to_the_rules(spark):
    frame = signals(spark, *[(t, "warn_spike", "low", f"warn {chr(97 + t)}") for t in range(3)])
    targets = [Target(assessments_per_day=2)]
    decided = incidents.cooldown(incidents.incidents(frame, targets), targets)
    answers = decided.selectExpr("target", "signature", "w_end", "false AS ext_anomalous", "'low' AS ext_severity",
                                 "'s' AS ext_summary", "'c' AS ext_cause", "'a' AS ext_action")
    answered = incidents.with_signals(incidents.with_answers(decided, answers, targets), frame, targets)
    out = {r.w_end: r for r in incidents.verdict(answered).collect()}
    assert [(out[t].external_verdict, out[t].anomalous) for t in range(3)] == [(True, False), (True, False), (False, True)]


def test_digest_times(spark):
    day = 86400

    def sent(hours, **settings):
        cycles = spark.createDataFrame([(h * 3600,) for h in hours], "w_end BIGINT")
        return sorted(r.w_end // 3600 for r in history.digest_times(cycles, **settings).collect())

    assert sent([6, 7, 8, 30, 31, 55]) == [7, 31, 55]
    assert sent([6, 30 - 24]) == []  # never late enough
    assert sent([7, 31, 55, 79], period_days=2) == [7, 55]
    assert sent([7, 31, 103, 127], period_days=2) == [7, 103]  # a gap shifts what follows
    assert sent([31, 55], last="1970-01-02") == [55]
    assert sent([31, 55], last="1970-01-01", period_days=2) == [55]
    alerts = spark.createDataFrame([("a", 7 * 3600 - 1), ("a", 7 * 3600), ("b", 7 * 3600), ("a", 31 * 3600)], "target STRING, w_end BIGINT")
    times = spark.createDataFrame([(7 * 3600,), (31 * 3600,), (30 * day,)], "w_end BIGINT")
    assert sorted(map(tuple, history.alerts_due(times, alerts).collect())) == [(7 * 3600, 1), (31 * 3600, 2), (30 * day, 0)]


def test_reports_read_only_the_months_they_need(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.sql("SELECT timestamp_ntz'2024-01-31 23:59:59' + make_dt_interval(n * 31) AS ts, 'high' AS severity, 't' AS target"
                     " FROM range(4) t(n)").selectExpr("*", "date_format(ts, 'yyyy.MM') AS month")
    history.append_alerts(rows, path)
    since, until = 1706745599, 1706745599 + 32 * 86400  # the last second of January, into March
    stored = history.read_alerts(spark, path, rows.schema, since, until)
    assert stored.count() == 2 and len(stored.inputFiles()) >= 2
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
