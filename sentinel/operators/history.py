"""Memory across windows: first-seen fingerprints, alert history, digests, reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.config import Span, Target, bucket_seconds, with_limits
from sentinel.functions import fixed_values as fv
from sentinel.functions import sql, text
from sentinel.operators import gate
from sentinel.operators.facts import as_timestamp
from sentinel.operators.windows import spine, top_k, window_end

DAY = 86400


# ---- first seen ------------------------------------------------------------------------------

def first_seen(templates: DataFrame) -> DataFrame:
    """Windows in which a fingerprint appears for the first time, or again after it was forgotten."""
    return (
        gate.window_fingerprints(templates).where("seen").selectExpr("*", gate.LAST_SEEN)
        .where(f"NOT {gate.KNOWN}").select("target", "w_end", "fp", "last_seen")
    )


def merge_seen(known: DataFrame | None, batch: DataFrame, now: int) -> DataFrame:
    """Fold a batch of (target, fp, w_end) into the (target, fp, last_seen) table and forget."""
    merged = batch.selectExpr("target", "fp", "w_end AS last_seen")
    if known is not None:
        merged = merged.unionByName(known.select("target", "fp", "last_seen"))
    latest = merged.groupBy("target", "fp").agg(F.expr("max(last_seen) AS last_seen"))
    return retain(latest, "last_seen", now, fv.SEEN_RETENTION)


def retain(rows: DataFrame, time: str, now: int, kept_seconds: int) -> DataFrame:
    """Drop history older than its retention; the age limit itself is kept."""
    return rows.where(f"{time} >= {now - kept_seconds}L")


# ---- alert documents -------------------------------------------------------------------------

def alert_documents(alerts: DataFrame, levels: DataFrame, windows: DataFrame,
                    templates: DataFrame, targets: list[Target]) -> DataFrame:
    """One nested document per alert: verdict, signals, both windows' levels, top messages."""
    keys = ["target", "w_end"]

    def counts(side: str, name: str):
        return F.expr("map_from_entries(array_sort(collect_list(CASE WHEN"
                      f" {side} > 0 THEN struct(level, {side}) END))) AS {name}")

    level_maps = levels.groupBy(*keys).agg(counts("cur", "levels"), counts("base", "base_levels"))
    top = (
        top_k(templates.where("NOT is_base"), keys, ["n DESC", "message ASC"], fv.ALERT_MESSAGES, rank="place")
        .groupBy(*keys)
        .agg(F.expr("transform(array_sort(collect_list(struct(place, message, n))), m ->"
                    " named_struct('message', m.message, 'count', m.n)) AS top_error_messages"))
    )
    ts = as_timestamp("w_end")
    no_map = "CAST(map() AS map<string,bigint>)"
    rows = (alerts.join(windows.select(*keys, "total", "base_total"), keys)
            .join(level_maps, keys, "left").join(top, keys, "left"))
    return with_limits(rows, targets).selectExpr(
        f"{ts} AS ts", "target", "severity", "summary", "suspected_cause", "recommended_action",
        "external_verdict", "delivered", "signature", "forced", "monitored_indices",
        "window_hours", "signals",
        f"named_struct('total', total, 'levels', coalesce(levels, {no_map}),"
        " 'top_error_messages', coalesce(top_error_messages,"
        " CAST(array() AS array<struct<message:string,count:bigint>>))) AS window",
        f"named_struct('total', base_total, 'levels', coalesce(base_levels, {no_map}))"
        " AS baseline",
        f"concat(alert_index_prefix, '-', date_format({ts}, 'yyyy.MM')) AS alert_index",
        f"date_format({ts}, 'yyyy.MM') AS month",
    )


def append_alerts(documents: DataFrame, path: str) -> None:
    """Append to the history, one folder per target and month."""
    documents.write.mode("append").partitionBy("target", "month").parquet(path)


def read_alerts(spark: SparkSession, path: str, schema, since: int | None = None, until: int | None = None) -> DataFrame:
    """The written history from `since` on and before `until` (epoch seconds); reports read it instead of raw logs.

    Folders of other months are not listed into the scan, other times do not leave it.
    """
    rows = spark.read.schema(schema).parquet(path)
    for bound, test, months in ((since, ">=", ">="), (until, "<", "<=")):
        if bound is not None:
            at = as_timestamp(f"{bound}L")
            rows = rows.where(f"ts {test} {at} AND month {months} date_format({at}, 'yyyy.MM')")
    return rows


# ---- digest ----------------------------------------------------------------------------------

def digest_times(cycles: DataFrame, period_days: int = 1, hour: int = 7, last: str | None = None) -> DataFrame:
    """Of the cycles (w_end), those that send a digest: the first one of a UTC day at or after `hour`, if the
    day lies `period_days` or more after the day of the digest before. `last` is that day of an earlier run.

    One number per day is walked in order, whatever the number of cycles.
    """
    day, into = f"CAST(floor(w_end / {DAY}) AS BIGINT)", f"pmod(w_end, {DAY}L) >= {hour * 3600}"
    first = cycles.where(into).groupBy(F.expr(day).alias("day")).agg(F.expr("min(w_end) AS w_end"))
    before = "CAST(NULL AS BIGINT)" if last is None else f"CAST(unix_date(DATE'{last}') AS BIGINT)"
    walk = (f"aggregate(array_sort(collect_list(day)), named_struct('last', {before}, 'sent', CAST(array() AS array<bigint>)),"
            f" (s, d) -> CASE WHEN s.last IS NULL OR d - s.last >= {period_days}"
            " THEN named_struct('last', d, 'sent', array_append(s.sent, d)) ELSE s END, s -> s.sent)")
    sent = first.agg(F.expr(walk).alias("days")).selectExpr("explode(days) AS day")
    return first.join(sent, "day").select("w_end")


def alerts_due(times: DataFrame, alerts: DataFrame, period_days: int = 1) -> DataFrame:
    """For each digest that is due, how many alerts its period has; periods may overlap.

    An alert is put on each day it can count for, so both sides meet by day.
    """
    hours = period_days * DAY
    days = f"sequence(CAST(floor(w_end / {DAY}) AS BIGINT), CAST(floor((w_end + {hours}) / {DAY}) AS BIGINT))"
    dated = alerts.groupBy("w_end").agg(F.expr("count(*) AS n")).selectExpr("w_end AS at", "n", f"explode({days}) AS day")
    return (times.selectExpr("w_end", f"CAST(floor(w_end / {DAY}) AS BIGINT) AS day").join(dated, "day", "left")
            .groupBy("w_end").agg(F.expr(f"coalesce(sum(CASE WHEN at >= w_end - {hours} AND at < w_end THEN n END), 0L) AS alerts")))



def digest_targets(targets: list[Target], period_days: int) -> list[Target]:
    """The same targets with one window per digest period."""
    return [replace(t, window_hours=24.0 * period_days, baseline_mode="previous") for t in targets]


def digest(counts: DataFrame, messages: DataFrame, alerts: DataFrame, targets: list[Target],
           span: Span, period_days: int = 1, step: int | None = None) -> DataFrame:
    """Per target and period: rows, errors, warnings, alerts, top messages and the headline.

    `step` is the bucket of the facts; one that doesn't divide the period would put rows into a neighbour.
    """
    if period_days * DAY % (step or bucket_seconds(targets)):
        raise ValueError("buckets must divide the digest period: pass it to Watch as one of `periods`")
    periods = digest_targets(targets, period_days)
    keys = ["target", "w_end"]
    totals = gate.window_counts(counts, periods, span).select(*keys, "total", "err", "warn")
    raised = (
        alerts.selectExpr("target",
                          f"{window_end('w_end', span.anchor, period_days * DAY)} AS w_end")
        .groupBy(*keys).agg(F.expr("count(*) AS alerts"))
    )
    scrubbed = sql.is_in("target", [t.name for t in targets if t.scrub_pii])
    shown = sql.when(scrubbed, text.scrub("message"), "message")
    top = (
        gate.top_messages(messages, periods, span, k=fv.DIGEST_MESSAGES)
        .selectExpr(*keys, "rank", f"{shown} AS message", "n").groupBy(*keys)
        .agg(F.expr("transform(array_sort(collect_list(struct(rank, message, n))),"
                    " m -> struct(m.message, m.n)) AS top_errors"))
    )
    # one row per target and period, so a period's partition is as small as the configuration
    headline = sql.when("all_alerts = 0", sql.text(fv.DIGEST_QUIET),
                        sql.fill(fv.DIGEST_ALERTS, n="all_alerts"))
    return (
        totals.join(raised, keys, "left").join(top, keys, "left")
        .selectExpr(*keys, "total", "err", "warn", "coalesce(alerts, 0L) AS alerts", "top_errors")
        .selectExpr("*", "sum(alerts) OVER (PARTITION BY w_end) AS all_alerts")
        .selectExpr("*", f"{headline} AS headline").drop("all_alerts")
    )


def quiet_days(alerts: DataFrame, span: Span, spark: SparkSession) -> DataFrame:
    """Daily check times without any alert, of any target, in the 24 hours up to and including it."""
    days = spine(spark, [Target(name="check", window_hours=24.0)], span).select("w_end")
    into = f"pmod(w_end - {span.anchor}L, {DAY}L)"
    checks = sql.when(f"{into} = 0", f"array(w_end, w_end + {DAY}L)",
                      f"array(w_end - {into} + {DAY}L)")
    noisy = alerts.selectExpr(f"explode({checks}) AS w_end").distinct()
    return days.join(noisy, "w_end", "left_anti")


# ---- reports over the alert history ----------------------------------------------------------

def alerts_over_time(documents: DataFrame) -> DataFrame:
    """Alerts per day and severity; a day shows its five most frequent severities."""
    counted = (
        documents.selectExpr("CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) AS day", "severity")
        .groupBy("day", "severity").agg(F.expr("count(*) AS alerts"))
    )
    return top_k(counted, ["day"], ["alerts DESC", "severity ASC"], 5).drop("rank")


def alerts_by_severity(documents: DataFrame, k: int = 5) -> DataFrame:
    return (documents.groupBy("severity").agg(F.expr("count(*) AS alerts"))
            .orderBy(F.desc("alerts"), "severity").limit(k))


def top_signal_kinds(documents: DataFrame, k: int = 10) -> DataFrame:
    """Each alert counts once for every distinct kind it has."""
    return (documents.selectExpr("explode(array_distinct(signals.kind)) AS kind")
            .groupBy("kind").agg(F.expr("count(*) AS alerts"))
            .orderBy(F.desc("alerts"), "kind").limit(k))


def recent_alerts(documents: DataFrame, k: int = 500) -> DataFrame:
    return (documents.selectExpr("ts", "target", "severity", "summary",
                                 "array_join(signals.kind, ',') AS kinds", "delivered",
                                 "external_verdict")
            .orderBy(F.desc("ts"), "target").limit(k))


def run_counters(signals: DataFrame, decided: DataFrame, windows: DataFrame) -> DataFrame:
    """Evaluated windows, alerts, suppressed alerts, and signals by kind before any suppression."""
    labels = (
        windows.selectExpr("'cycles_total' AS counter", "'' AS label")
        .union(decided.where("NOT alerted OR anomalous").selectExpr(
            "CASE WHEN alerted THEN 'alerts_total' ELSE 'suppressed_total' END AS counter", "'' AS label"))
        .union(signals.selectExpr("'signals_total' AS counter", "kind AS label"))
    )
    return labels.groupBy("counter", "label").agg(F.expr("count(*) AS value"))
