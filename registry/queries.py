"""Registered queries: each takes (spark, folder of parquet tables) and returns a DataFrame."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import settings as cfg
from sentinel.config import Span, parse_time
from sentinel.functions import fixed_values as fv
from sentinel.functions.index_names import index_family
from sentinel.operators import (
    access,
    gate,
    history,
    hosts,
    incidents,
    normalize,
    quality,
    redaction,
    silence,
)
from sentinel.operators.facts import HOST_PHRASES, as_timestamp
from sentinel.operators.windows import assign
from sentinel.operators.windows import spine
from sentinel.plans.watch import Fleet, Watch, flat
from sentinel.session import materialize, new_path, use_utc
from sentinel.sources.event_logs import clashing_documents, event_logs, raw_documents
from sentinel.sources.logs import scan
from sentinel.streaming import jobs, state

QUERIES = {}
W_END = f"{as_timestamp('w_end')} AS w_end"


def query(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(use_utc(spark), folder)

    run.__name__ = function.__name__
    QUERIES[function.__name__] = run
    return function


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def logs(spark, folder):
    return event_logs(table(spark, folder, "events"))


def all_logs(spark, folder):
    """Every event as a log row, without the planted outages."""
    return event_logs(table(spark, folder, "events"), outages=False)


def watch(spark, folder, targets=cfg.MAIN, span=cfg.SPAN, written=False):
    return Watch(logs(spark, folder), targets, span, written=written)


# ---- sources ---------------------------------------------------------------------------------

@query
def scan_window(spark, folder):
    rows = scan(logs(spark, folder), cfg.SCAN_INDICES, parse_time(cfg.SCAN_FROM),
                parse_time(cfg.SCAN_TO))
    return rows.select("event_id", "ts", "index_name", "level", "message")


@query
def error_samples(spark, folder):
    w = watch(spark, folder)
    return gate.error_samples(w.rows, w.targets, w.span).selectExpr(
        "target", W_END, "CAST(rank AS BIGINT) AS rank", "ts", "event_id", "sample")


@query
def field_coverage(spark, folder):
    return quality.field_coverage(all_logs(spark, folder), cfg.COVERAGE_FIELDS)


# ---- normalisation ---------------------------------------------------------------------------

def _normalized(spark, folder):
    raw = raw_documents(table(spark, folder, "events"))
    return normalize.normalize(raw).selectExpr(
        "CAST(get_json_object(document, '$.event_id') AS BIGINT) AS event_id", "*")


@query
def normalize_logs(spark, folder):
    return _normalized(spark, folder).selectExpr(
        "event_id", "ts", "level", "message", "service", "environment", "user_name", "user_id",
        "logger", "host", "url_path", "http_method", "status_code", "status_is_number",
        "array_join(tags, ',') AS tags",
        "array_join(array_sort(transform(map_entries(labels), e -> concat(e.key, '=', e.value))),"
        " ',') AS labels")


@query
def normalize_errors(spark, folder):
    return (_normalized(spark, folder).where("schema_error IS NOT NULL")
            .groupBy("schema_error").agg(F.expr("count(*) AS n")))


@query
def normalize_conflicts(spark, folder):
    """Each of the six renames clashes in some documents: what ran before, and what the rest keeps."""
    rows = normalize.normalize(clashing_documents(table(spark, folder, "events")))
    return rows.groupBy("schema_error").agg(
        F.expr("count(*) AS n"), F.expr("count_if(user_name LIKE 'u%') AS users"),
        *[F.expr(f"count_if({c} = 'old') AS {c}s") for c in ("level", "logger", "host", "url_path", "http_method")],
        F.expr("count_if(status_code = 200) AS statuses"),
        F.expr("count_if(rest LIKE '%MachineName%') AS kept_machines"),
        F.expr("sum(CAST(get_json_object(rest, '$.host.cores') AS BIGINT)) AS cores"))


@query
def normalize_rest(spark, folder):
    """Unknown and unconsumed keys after the normalisation ran over its own result."""
    once = normalize.normalize(raw_documents(table(spark, folder, "events")))
    twice = normalize.normalize(normalize.to_document(once))
    kept = ("event_id string, level string, metadata struct<LogTags: string>,"
            " fields struct<Application: string, MachineName: string, UserName: string>")
    return twice.selectExpr(f"from_json(rest, '{kept}') AS kept", "schema_error").selectExpr(
        "CAST(kept.event_id AS BIGINT) AS event_id", "kept.fields.Application AS application", "kept.level AS old_level",
        "kept.fields.MachineName AS machine", "kept.fields.UserName AS user", "kept.metadata.LogTags AS metadata_tags",
        "schema_error")


@query
def fold_tags(spark, folder):
    return (_normalized(spark, folder).selectExpr("explode(tags) AS tag", "event_id")
            .where("tag NOT IN ('heartbeat','healthcheck','request','auth','startup','db')")
            .groupBy("tag").agg(F.expr("count(*) AS n"), F.expr("min(event_id) AS first_event")))


@query
def derive_tags(spark, folder):
    return (_normalized(spark, folder).selectExpr("explode(tags) AS tag", "event_id")
            .where("tag IN ('heartbeat','healthcheck','request','auth','startup','db')")
            .groupBy("tag").agg(F.expr("count(*) AS n"), F.expr("min(event_id) AS first_event")))


@query
def logs_without_noise(spark, folder):
    rows = normalize.without_noise(_normalized(spark, folder))
    return rows.select("event_id", "ts", "level", "message")


# ---- text ------------------------------------------------------------------------------------

@query
def fingerprint_rollup(spark, folder):
    return redaction.fingerprint_rollup(all_logs(spark, folder))


@query
def fingerprint_documents(spark, folder):
    rows = redaction.fingerprint_rollup(table(spark, folder, "documents"), "text", "doc_id")
    return rows.selectExpr("fp", "n", "first_at AS first_doc", "last_at AS last_doc")


@query
def scrub_table(spark, folder):
    return redaction.scrub_table(table(spark, folder, "documents"), ["text"]).select(
        "doc_id", "lang", "source", "text")


@query
def scrub_pages(spark, folder):
    return redaction.scrub_table(table(spark, folder, "pages"), ["url", "html"]).select(
        "page_id", "url", "html")


@query
def pii_census(spark, folder):
    return redaction.pii_census(table(spark, folder, "documents"), "text", ["source"])


@query
def pii_census_conversations(spark, folder):
    return redaction.pii_census(table(spark, folder, "conversations"), "text", ["role"])


@query
def scrubbed_messages(spark, folder):
    return redaction.scrubbed_messages(all_logs(spark, folder))


@query
def phrase_counts(spark, folder):
    phrases = [p for group in HOST_PHRASES.values() for p in group]
    return redaction.phrase_counts(all_logs(spark, folder), "message", phrases)


# ---- counts ----------------------------------------------------------------------------------

@query
def window_totals(spark, folder):
    return watch(spark, folder).window_counts.selectExpr(
        "target", W_END, "total", "err", "warn", "fatal")


@query
def level_counts(spark, folder):
    return watch(spark, folder).levels.where("cur > 0").selectExpr(
        "target", W_END, "level", "cur AS n")


@query
def level_compare(spark, folder):
    return watch(spark, folder, cfg.MULTI).levels.selectExpr(
        "target", W_END, "level", "cur", "base")


@query
def index_family_counts(spark, folder):
    w = watch(spark, folder)
    rows = assign(w.counts, w.targets, w.span).selectExpr(
        "target", "w_end", f"{index_family()} AS family", "n")
    return rows.groupBy("target", "w_end", "family").agg(F.expr("sum(n) AS n")).selectExpr(
        "target", W_END, "family", "n")


@query
def top_messages(spark, folder):
    w = watch(spark, folder)
    return gate.top_messages(w.messages, w.targets, w.span).selectExpr(
        "target", W_END, "message", "n", "CAST(rank AS BIGINT) AS rank")


@query
def access_by_ip(spark, folder):
    w = watch(spark, folder)
    return access.busiest_clients(access.access_by_ip(w.requests), w.targets).selectExpr(
        "target", W_END, "source_ip", "total", "c4xx", "auth_fail", "scoped_fail",
        "distinct_paths")


@query
def host_counts(spark, folder):
    return watch(spark, folder).host_windows.selectExpr(
        "target", W_END, "host", "total", "base_total", "ssh_fail", "oom", "disk", "unit_fail")


@query
def baseline_compare(spark, folder):
    w = watch(spark, folder, cfg.MODES)
    return w.window_counts.selectExpr(
        "target AS mode", W_END, "total", "base_total", "err", "base_err")


# ---- detectors -------------------------------------------------------------------------------

def _gate(spark, folder, kind, ignored=False):
    w = watch(spark, folder)
    windows = w.windows if ignored else w.window_counts
    return flat(gate.gate_signals(windows, w.targets, (kind,)))


@query
def error_spike(spark, folder):
    return _gate(spark, folder, "error_spike")


@query
def warn_spike(spark, folder):
    return _gate(spark, folder, "warn_spike", ignored=True)


@query
def ignore_degraded(spark, folder):
    w = watch(spark, folder, cfg.LISTED)
    return gate.ignore_degraded(w.windows, w.targets).selectExpr(
        "target", W_END, "warn", "n_templates", "reason")


@query
def fatal(spark, folder):
    return _gate(spark, folder, "fatal")


@query
def ingestion_stopped(spark, folder):
    return _gate(spark, folder, "ingestion_stopped")


@query
def new_errors(spark, folder):
    w = watch(spark, folder)
    return flat(gate.new_error_signals(w.templates, w.targets))


@query
def new_errors_live(spark, folder):
    w = watch(spark, folder)
    return flat(gate.new_error_signals(w.templates, w.targets, live=True))


@query
def live_cycle(spark, folder):
    """Two cycles, the second with the memory of the first: the same signals as one run over both."""
    first = watch(spark, folder, span=Span.replay(cfg.START, cfg.MIDDLE))
    second = watch(spark, folder, span=Span.replay(cfg.MIDDLE, cfg.END))
    known = materialize(first.seen(), "seen")
    return flat(gate.new_error_signals(first.templates, first.targets, live=True).union(
        gate.new_error_signals(second.templates, second.targets, live=True, known=known)))


@query
def live_cooldown(spark, folder):
    """Alerts of two runs over one half of the windows each, the second told of the first one's alerts."""
    w, found = _calm(spark, folder)
    rows = incidents.incidents(found, w.targets).selectExpr(
        "target", "w_end", "signature", "pmod(w_end, 86400) <> 43200 AS delivered")
    middle = parse_time(cfg.MIDDLE)
    first = materialize(incidents.cooldown(rows.where(f"w_end <= {middle}"), w.targets), "decided")
    earlier = first.where("alerted AND delivered").select("target", "signature", "w_end")
    second = incidents.cooldown(rows.where(f"w_end > {middle}"), w.targets, earlier)
    return first.unionByName(second).selectExpr("target", W_END, "signature", "delivered", "alerted")


@query
def index_silent(spark, folder):
    w = watch(spark, folder)
    return flat(silence.index_silent_signals(w.counts, w.targets, w.span))


@query
def heartbeat_missing(spark, folder):
    w = watch(spark, folder)
    return flat(silence.heartbeat_signals(w.rows, w.targets, w.span))


@query
def suspicious_requests(spark, folder):
    w = watch(spark, folder)
    return flat(access.suspicious_signals(access.suspicious_requests(w.requests), w.targets))


def _clients(spark, folder, kind):
    w = watch(spark, folder)
    clients = access.access_by_ip(w.requests)
    return flat(access.client_signals(clients, w.targets, (kind,)))


@query
def api_scan(spark, folder):
    return _clients(spark, folder, "api_scan")


@query
def auth_bruteforce(spark, folder):
    return _clients(spark, folder, "auth_bruteforce")


def _hosts(spark, folder, kind):
    w = watch(spark, folder)
    return flat(hosts.host_signals(w.host_windows, w.targets, (kind,)))


@query
def host_ssh_bruteforce(spark, folder):
    return _hosts(spark, folder, "linux_ssh_bruteforce")


@query
def host_oom(spark, folder):
    return _hosts(spark, folder, "linux_oom")


@query
def host_disk_errors(spark, folder):
    return _hosts(spark, folder, "linux_disk_errors")


@query
def host_unit_failures(spark, folder):
    return _hosts(spark, folder, "linux_unit_failures")


@query
def host_silent(spark, folder):
    return _hosts(spark, folder, "linux_host_silent")


# ---- whole evaluations -----------------------------------------------------------------------

@query
def all_signals(spark, folder):
    return flat(watch(spark, folder, written=True).signals())


@query
def multi_target_gate(spark, folder):
    w = watch(spark, folder, cfg.MULTI)
    return flat(gate.gate_signals(w.windows, w.targets))


@query
def replay_signals(spark, folder):
    return flat(watch(spark, folder, cfg.MULTI, written=True).signals(heartbeats=False))


@query
def fields_per_target(spark, folder):
    """Two targets over one log table: one reads level and text from inside a struct and a map."""
    source = logs(spark, folder).selectExpr(
        "*", "named_struct('level', CASE WHEN status_code >= 500 OR status_code IN (401, 403) THEN 'Error'"
        " WHEN status_code >= 400 THEN 'Warning' END) AS edge", "map('text', coalesce(url_path, message)) AS extra")
    return flat(Fleet(source, cfg.NAMED, cfg.SPAN, written=True).signals(heartbeats=False))


# ---- incidents -------------------------------------------------------------------------------

def _calm(spark, folder, **options):
    w = Watch(logs(spark, folder), cfg.CALM, cfg.SPAN, written=True, **options)
    return w, w.written_signals(heartbeats=False)


def _alerts(spark, folder, **options):
    w, found = _calm(spark, folder, **options)
    return w, w.alerts(found)


def _documents(spark, folder):
    w, found = _calm(spark, folder)
    return w.documents(w.alerts(found), found)


@query
def overall_severity(spark, folder):
    w = watch(spark, folder, cfg.MULTI, written=True)
    return incidents.overall_severity(w.signals(heartbeats=False)).selectExpr(
        "target", W_END, "severity", "n_signals")


@query
def signature_of_signals(spark, folder):
    w = watch(spark, folder, cfg.MULTI, written=True)
    return incidents.incidents(w.signals(heartbeats=False), w.targets).selectExpr(
        "target", W_END, "signature")


@query
def rule_verdict(spark, folder):
    w = watch(spark, folder, cfg.MULTI, written=True)
    rows = incidents.incidents(w.signals(heartbeats=False), w.targets)
    return incidents.verdict(rows).selectExpr(
        "target", W_END, "forced", "anomalous", "severity", "summary", "suspected_cause",
        "recommended_action", "external_verdict")


@query
def cooldown_dedupe(spark, folder):
    w, found = _calm(spark, folder)
    rows = incidents.incidents(found, w.targets).selectExpr(
        "target", "w_end", "signature", "pmod(w_end, 86400) <> 43200 AS delivered")
    return incidents.cooldown(rows, w.targets).selectExpr(
        "target", W_END, "signature", "delivered", "alerted")


@query
def daily_quota(spark, folder):
    w, alerts = _alerts(spark, folder)
    return incidents.daily_quota(alerts, w.targets).selectExpr(
        "target", W_END, "day", "CAST(nth AS BIGINT) AS nth", "within_budget",
        "CAST(remaining AS BIGINT) AS remaining")


@query
def budgeted_verdicts(spark, folder):
    """Every alert asks for an assessment that calls it low; those beyond the day's budget keep the rule verdict."""
    w, found = _calm(spark, folder)
    decided = incidents.cooldown(incidents.incidents(found, w.targets), w.targets)
    answers = decided.where("alerted").selectExpr(
        "target", "signature", "w_end", "true AS ext_anomalous", "'low' AS ext_severity", "'seen' AS ext_summary",
        "'known' AS ext_cause", "'none' AS ext_action")
    answered = incidents.with_answers(decided, answers, w.targets)
    rows = incidents.verdict(incidents.with_signals(answered, found, w.targets))
    return rows.where("alerted").selectExpr("target", W_END, "signature", "severity", "summary", "external_verdict")


@query
def verdict_asof(spark, folder):
    w, found = _calm(spark, folder)
    rows = incidents.incidents(found, w.targets).select("target", "w_end", "signature")
    # verdicts given at midnight and noon windows
    stored = rows.where("pmod(w_end, 43200) = 0").selectExpr(
        "target", "signature", "w_end AS ts",
        "CASE WHEN pmod(w_end, 86400) = 0 THEN 'low' ELSE 'high' END AS ext_severity")
    return incidents.verdict_asof(rows, stored, w.targets).selectExpr(
        "target", W_END, "signature", f"{as_timestamp('verdict_ts')} AS verdict_ts",
        "ext_severity")


def _shown(documents):
    return documents.selectExpr(
        "ts", "target", "severity", "summary", "forced", "signature", "window_hours",
        "array_join(monitored_indices, ',') AS monitored_indices",
        "array_join(transform(signals, s -> concat(s.kind, ':', s.severity_hint, ':', s.detail)),"
        " '|') AS signals",
        "window.total AS total",
        "array_join(transform(map_entries(window.levels),"
        " e -> concat(e.key, '=', e.value)), ',') AS levels",
        "array_join(transform(window.top_error_messages,"
        " m -> concat(m.message, '=', m.count)), '|') AS top_error_messages",
        "baseline.total AS base_total",
        "array_join(transform(map_entries(baseline.levels),"
        " e -> concat(e.key, '=', e.value)), ',') AS base_levels",
        "alert_index", "month")


@query
def alert_documents(spark, folder):
    return _shown(_documents(spark, folder))


@query
def run_counters(spark, folder):
    w, found = _calm(spark, folder)
    return history.run_counters(found, w.decided(found), w.window_counts)


# ---- history ---------------------------------------------------------------------------------

@query
def first_seen(spark, folder):
    w = watch(spark, folder)
    return history.first_seen(w.templates).selectExpr("target", W_END, "fp")


@query
def retain_history(spark, folder):
    now = parse_time(cfg.RETENTION_NOW)
    w, found = _calm(spark, folder)
    verdicts = incidents.incidents(found, w.targets).where("pmod(w_end, 43200) = 0")
    seen = w.seen().selectExpr("target", "last_seen AS w_end", "fp AS signature")
    histories = {"alerts": (w.alerts(found), fv.ALERT_RETENTION), "verdicts": (verdicts, fv.VERDICT_RETENTION),
                 "fingerprints": (seen, fv.SEEN_RETENTION)}
    kept = [history.retain(rows, "w_end", now, limit).selectExpr(
        f"'{name}' AS history", "target", W_END, "signature") for name, (rows, limit) in histories.items()]
    return kept[0].union(kept[1]).union(kept[2])


@query
def alert_append(spark, folder):
    """Alerts written as a history, a part of them twice, and read back."""
    documents = materialize(_documents(spark, folder), "documents")
    path = new_path(spark, "alerts")
    append = jobs.append_new_alerts(path)
    half = documents.where(f"ts < TIMESTAMP_NTZ'{cfg.MIDDLE[:10]} 00:00:00'")
    for number, batch in enumerate((half, half, documents)):
        append(batch, number)
    stored = spark.read.schema(documents.schema).parquet(path)
    return stored.selectExpr("ts", "target", "severity", "signature", "size(signals) AS n_signals", "month")


@query
def backfill_logs(spark, folder):
    """All history normalised into a table by day, its last days once more, and read back."""
    raw = raw_documents(table(spark, folder, "events"))
    path = new_path(spark, "backfill")
    normalize.backfill(raw, path)
    normalize.backfill(raw.where(f"get_json_object(document, '$.@timestamp') >= '{cfg.MIDDLE[:10]}'"), path)
    return spark.read.parquet(path).selectExpr(
        "CAST(get_json_object(document, '$.event_id') AS BIGINT) AS event_id", "ts", "level", "service", "user_name")


@query
def digest(spark, folder):
    w, alerts = _alerts(spark, folder, raw_templates=True)
    return history.digest(w.counts, w.messages, alerts, w.targets, w.span, cfg.DIGEST_DAYS, w.step) \
        .selectExpr("target", W_END, "total", "err", "warn", "alerts", "headline",
                    "array_join(transform(top_errors, e -> concat(e.message, '=', e.n)), '|')"
                    " AS top_errors")


@query
def digest_due(spark, folder):
    """Every second day the first cycle from seven on sends a digest of the alerts before it."""
    w, alerts = _alerts(spark, folder)
    times = history.digest_times(spine(spark, w.targets, w.span), cfg.DUE_DAYS, cfg.DUE_HOUR)
    return history.alerts_due(times, alerts, cfg.DUE_DAYS).selectExpr(W_END, "alerts")


@query
def history_report(spark, folder):
    """Alerts over time from the written history, a part of a month of it."""
    documents = _documents(spark, folder)
    path = new_path(spark, "history")
    history.append_alerts(documents, path)
    stored = history.read_alerts(spark, path, documents.schema, parse_time(cfg.REPORT_FROM), parse_time(cfg.REPORT_TO))
    return history.alerts_over_time(stored)


@query
def run_counters_assessed(spark, folder):
    """Run counters where assessments call each midnight's window normal; forced kinds alarm all the same."""
    w, found = _calm(spark, folder)
    decided = incidents.cooldown(incidents.incidents(found, w.targets), w.targets).selectExpr(
        "*", "CASE WHEN pmod(w_end, 86400) = 0 THEN false END AS ext_anomalous",
        *[f"CAST(NULL AS STRING) AS {c}" for c in ("ext_severity", "ext_summary", "ext_cause", "ext_action")])
    rows = incidents.verdict(incidents.with_signals(decided, found, w.targets))
    return history.run_counters(found, rows, w.window_counts)


@query
def quiet_days(spark, folder):
    w, alerts = _alerts(spark, folder)
    return history.quiet_days(alerts, w.span, spark).selectExpr(W_END)


@query
def alerts_over_time(spark, folder):
    return history.alerts_over_time(_documents(spark, folder))


@query
def alerts_by_severity(spark, folder):
    return history.alerts_by_severity(_documents(spark, folder))


@query
def top_signal_kinds(spark, folder):
    return history.top_signal_kinds(_documents(spark, folder))


@query
def recent_alerts(spark, folder):
    return history.recent_alerts(_documents(spark, folder), 25)




# ---- streams: everything available now, then the table the stream wrote ------------------------

def _event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    # the table's own path, be it one file or a folder of many; a stream takes a file only by a pattern
    return jobs.read_stream(spark, f"{folder}/events[.]parquet", schema)


@query
def stream_normalize(spark, folder):
    rows = normalize.normalize(raw_documents(_event_stream(spark, folder)))
    rows = rows.selectExpr(
        "CAST(get_json_object(document, '$.event_id') AS BIGINT) AS event_id", "ts", "level",
        "service", "user_name", "array_join(tags, ',') AS tags")
    return jobs.run_to_table(rows, "normalized")


def _streamed_counts(spark, folder):
    rows = event_logs(_event_stream(spark, folder))
    return jobs.run_bucket_counts(rows, cfg.MAIN, cfg.SPAN, new_path(spark, "buckets"), new_path(spark, "buckets-checkpoint"))


@query
def stream_bucket_counts(spark, folder):
    return _streamed_counts(spark, folder).selectExpr(f"{as_timestamp('bucket')} AS bucket", "index_name", "level", "n")


@query
def stream_index_silent(spark, folder):
    return flat(silence.index_silent_signals(_streamed_counts(spark, folder), cfg.MAIN, cfg.SPAN))


@query
def stream_heartbeats(spark, folder):
    """Silences known at the end of the span, also that of a service that never spoke."""
    state.use_state_store(spark)
    clock = jobs.new_clock(spark)
    minutes = jobs.heartbeat_minutes(jobs.with_clock(event_logs(_event_stream(spark, folder)), clock), cfg.GHOST)
    found = state.missing_heartbeats(minutes, state.expected_services(spark, cfg.GHOST, cfg.SPAN.start))
    found = jobs.run_to_table(found, "heartbeats", clock, cfg.SPAN.end)
    return found.selectExpr("target", "service", f"{as_timestamp('last_second')} AS last_seen",
                            f"{as_timestamp('missing_since')} AS missing_since")


def _shuffled_stream(rows, label, time):
    """The rows of a table as a stream of files that come in no order of time, one a batch."""
    spark = rows.sparkSession
    path = new_path(spark, label)
    rows.repartition(cfg.STREAM_FILES, time).write.parquet(path)
    return jobs.read_stream(spark, path, rows.schema, files_per_batch=1)


@query
def stream_cooldown(spark, folder):
    state.use_state_store(spark)
    w, found = _calm(spark, folder)
    rows = incidents.incidents(found, w.targets).selectExpr(
        "target", "w_end", "signature", "pmod(w_end, 86400) <> 43200 AS delivered")
    clock, late = jobs.new_clock(spark), cfg.SPAN.end - cfg.SPAN.start
    stream = state.cooldown(_shuffled_stream(rows, "incidents", "w_end"), w.targets, late, clock)
    return jobs.run_to_table(stream, "cooldown", clock, cfg.SPAN.end, late).selectExpr(
        "target", W_END, "signature", "delivered", "alerted")


@query
def stream_first_seen(spark, folder):
    state.use_state_store(spark)
    w = watch(spark, folder)
    rows = gate.window_fingerprints(w.templates).where("seen").select("target", "fp", "w_end")
    clock, late = jobs.new_clock(spark), cfg.SPAN.end - cfg.SPAN.start
    stream = state.first_seen(_shuffled_stream(rows, "fingerprints", "w_end"), late, clock)
    return jobs.run_to_table(stream, "first-seen", clock, cfg.SPAN.end, late).selectExpr("target", W_END, "fp")


class _Killed(Exception):
    pass


@query
def stream_alerts(spark, folder):
    """Alert documents sent file by file, some of them twice, to a sink that is killed between a write and its
    commit, and started again."""
    documents = _documents(spark, folder)
    twice = documents.union(documents.where(f"ts < TIMESTAMP_NTZ'{cfg.MIDDLE[:10]} 00:00:00'"))
    stream = _shuffled_stream(twice, "alert-files", "ts")
    path, checkpoint = new_path(spark, "alerts"), new_path(spark, "alerts-checkpoint")
    sink = jobs.alert_sink(path, documents.schema)

    def killed(batch, number):
        sink(batch, number)
        if number == 1:
            raise _Killed

    try:
        jobs.drain(stream, killed, checkpoint)
    except StreamingQueryException as stopped:
        if "_Killed" not in str(stopped):
            raise
    jobs.drain(stream, sink, checkpoint)
    return _shown(jobs.read_batches(spark, path, documents.schema))
