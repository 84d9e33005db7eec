"""Absence: index families and services that stopped logging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.config import Span, Target, bucket_seconds, with_limits
from sentinel.functions import sql, text
from sentinel.functions.index_names import index_family, index_matches
from sentinel.operators import signals
from sentinel.operators.facts import SECOND
from sentinel.operators.windows import per_target, window_end


def family_buckets(counts: DataFrame, targets: list[Target]) -> DataFrame:
    """Rows per target, index family and bucket."""
    matches = [sql.when(index_matches(t.indices), sql.text(t.name)) for t in targets]
    return (
        counts.selectExpr(f"explode({sql.compact(matches)}) AS target",
                          f"{index_family()} AS family", "bucket", "n")
        .groupBy("target", "family", "bucket").agg(F.expr("sum(n) AS n"))
    )


def family_windows(counts: DataFrame, targets: list[Target], span: Span, step: int | None = None) -> DataFrame:
    """Rolling counts per index family: the silence window before each end, and the one before it.

    `step` is the bucket of the facts, by default that of these targets together.

    A running sum over a gapless bucket grid turns every rolling count into a difference of two
    values, so the cost does not depend on how many windows overlap. A partition is one family's
    buckets, never its rows.
    """
    step = step or bucket_seconds(targets)
    targets = [t for t in targets if t.silence_window]
    first = per_target(
        targets, lambda t: f"{span.first_end(t.window) - 2 * t.silence_window}L")
    last = per_target(targets, lambda t: f"{span.last_end(t.window)}L")
    line = "PARTITION BY target, family ORDER BY bucket"
    # each bucket also fills the gap up to the next one, the first also the time before it
    begin = f"CASE WHEN prev IS NULL THEN {first} ELSE bucket END"
    until = f"CASE WHEN next IS NULL THEN {last} ELSE next - {step}L END"
    dense = (
        family_buckets(counts, targets).where(f"bucket BETWEEN {first} AND {last}")
        .selectExpr("*", f"lag(bucket) OVER ({line}) AS prev", f"lead(bucket) OVER ({line}) AS next")
        .selectExpr("target", "family", "bucket AS own", "n",
                    f"explode(sequence({begin}, {until}, {step}L)) AS bucket")
        .selectExpr("target", "family", "bucket", "CASE WHEN bucket = own THEN n ELSE 0L END AS n")
    )

    def earlier(times: int) -> str:
        return per_target(targets, lambda t: (
            f"lag(before, {times * t.silence_window // step}, 0L) OVER ({line})"))

    is_end = per_target(targets, lambda t: (
        f"{span.covers('bucket', t.window)}"
        f" AND pmod(bucket - {span.anchor}L, {t.window}L) = 0"), "false")
    return (
        dense.selectExpr("target", "family", "bucket", f"coalesce(sum(n) OVER ({line} ROWS BETWEEN"
                         " UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before")
        .selectExpr("*", f"{earlier(1)} AS one", f"{earlier(2)} AS two")
        .where(is_end)
        .selectExpr("target", "family", "bucket AS w_end", "before - one AS cur",
                    "one - two AS base")
    )


def index_silent_signals(counts: DataFrame, targets: list[Target], span: Span, step: int | None = None) -> DataFrame:
    """A family fell silent while at least one other still logs."""
    rows = family_windows(counts, targets, span, step).selectExpr(
        "*", "sum(cur) OVER (PARTITION BY target, w_end) AS alive"
    ).where("alive > 0 AND cur = 0 AND base > 0")
    return signals.emit(with_limits(rows, targets), (
        "base >= min_errors",
        signals.signal("index_silent", cur="cur", base="base", threshold="min_errors",
                       entity="family", hours="silent_hours"),
    ))


def heartbeat_counts(rows: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    """Signs of life per expected service shortly before each window end, zeros included."""
    targets = [t for t in targets if t.heartbeats]
    # most rows are not close enough to a window end: drop them before looking at their text
    close = sql.any_of([f"{window_end(SECOND, span.anchor, t.window)} <= {SECOND} + {t.staleness}L"
                        for t in targets])
    hits, expected = [], []  # both sized by the configuration
    for t in targets:
        # ends w with w - staleness <= ts < w
        first = window_end("second", span.anchor, t.window)
        ends = sql.when(f"{first} <= second + {t.staleness}L",
                        f"sequence({first}, second + {t.staleness}L, {t.window}L)")
        for service, index, phrase in t.heartbeats:
            name = {"target": sql.text(t.name), "service": sql.text(service)}
            hits.append(sql.when(f"{index_matches([index])} AND {text.has_phrase('words', [phrase])}",
                                 sql.struct(**name, ends=ends)))
            if span.last_end(t.window) >= span.first_end(t.window):
                expected.append(sql.struct(**name, ends=f"sequence({span.first_end(t.window)}L,"
                                           f" {span.last_end(t.window)}L, {t.window}L)"))
    inside = per_target(targets, lambda t: span.covers("w_end", t.window), "false")
    heard = (
        rows.where(close)
        .selectExpr("index_name", f"{SECOND} AS second", f"{text.words('message')} AS words")
        .selectExpr(f"inline({sql.compact(hits)})")
        .selectExpr("target", "service", "explode(ends) AS w_end", "1L AS hits").where(inside)
    )
    silent = (
        rows.sparkSession.range(1, numPartitions=1)
        .selectExpr(f"inline(array({', '.join(expected)}))")
        .selectExpr("target", "service", "explode(ends) AS w_end", "0L AS hits")
    )
    return (heard.unionByName(silent).groupBy("target", "service", "w_end")
            .agg(F.expr("sum(hits) AS hits")))


def heartbeat_signals(rows: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    counts = heartbeat_counts(rows, targets, span).where("hits = 0")
    return signals.emit(with_limits(counts, targets), (
        "true",
        signals.signal("heartbeat_missing", cur="hits", entity="service", minutes="stale_minutes"),
    ))
