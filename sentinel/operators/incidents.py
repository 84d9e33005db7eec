"""From signals to incidents: signatures, verdicts, cooldown, quota."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.config import Target, with_limits
from sentinel.functions import fixed_values as fv
from sentinel.functions import sql, text

_RANKS = " ".join(f"WHEN {sql.text(s)} THEN {i}" for i, s in enumerate(fv.SEVERITY_ORDER))
SEVERITY_RANK = f"CASE severity {_RANKS} ELSE 0 END"
_KINDS = sql.literal(list(fv.SEVERITY))


def overall_severity(signals: DataFrame) -> DataFrame:
    """Highest severity of each window."""
    return signals.groupBy("target", "w_end").agg(
        F.expr(f"max_by(severity, {SEVERITY_RANK}) AS severity"), F.expr("count(*) AS n_signals"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted signals to windows, one after the other: held are a digest, a rank and a flag."""
    names = ["target", "w_end", "signature", "rule_severity", "forced"]
    key, digest, empty, best, forced = None, hashlib.sha256(), True, (-1, None), False

    def closed() -> tuple:
        return (*key, digest.hexdigest()[:16], best[1], forced)

    def packed(done: list) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    for batch in batches:
        done = []
        for target, end, part, severity, rank, force in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (target, end) != key:
                if key is not None:
                    done.append(closed())
                key, digest, empty, best, forced = (target, end), hashlib.sha256(), True, (-1, None), False
            if part is not None:
                digest.update(part.encode() if empty else b"|" + part.encode())
                empty = False
            if rank > best[0]:
                best = (rank, severity)
            forced = forced or bool(force)
        if done:
            yield packed(done)
    if key is not None:
        yield packed([closed()])


def incidents(signals: DataFrame, targets: list[Target]) -> DataFrame:
    """One row per window with signals: signature, highest severity, and whether a kind forces the alarm.

    The signature is taken from the raw texts, before redaction makes two clients look alike. Signals stay a
    long table: they stream past in order, so a window may have any number of them.
    """
    line = signals.selectExpr(
        "target", "w_end", f"concat(kind, ':', {text.mask_counters('detail')}) AS part", "severity",
        f"{SEVERITY_RANK} AS rank", f"{sql.is_in('kind', fv.FORCED_KINDS)} AS forced")
    line = line.repartition("target", "w_end").sortWithinPartitions("target", "w_end", "part")
    return line.mapInArrow(_folded, "target STRING, w_end BIGINT, signature STRING, rule_severity STRING, forced BOOLEAN")


def with_signals(rows: DataFrame, signals: DataFrame, targets: list[Target]) -> DataFrame:
    """Add each row's redacted signals as its document stores them: one array, in the order of kinds.

    For windows that become documents, or whose summary may quote signals.
    """
    keys = ["target", "w_end"]
    scrubbed = sql.is_in("target", [t.name for t in targets if t.scrub_pii])
    shown = sql.when(scrubbed, text.scrub("detail"), "detail")
    listed = (
        signals.selectExpr(*keys, f"named_struct('position', array_position({_KINDS}, kind), 'kind', kind,"
                                  f" 'severity_hint', severity, 'detail', {shown}) AS signal")
        .groupBy(*keys)
        .agg(F.expr("transform(array_sort(collect_list(signal)), s -> named_struct('kind', s.kind,"
                    " 'severity_hint', s.severity_hint, 'detail', s.detail)) AS signals"))
    )
    return rows.join(listed, keys, "left")


def verdict(rows: DataFrame) -> DataFrame:
    """Rule verdict; an external one (columns ext_*) wins; forced kinds always alarm, high.

    With external verdicts rows need their `signals`, as an empty summary is replaced by texts of these.
    """
    texts = ["ext_severity", "ext_summary", "ext_cause", "ext_action"]
    if "ext_anomalous" not in rows.columns:
        rows = rows.selectExpr("*", "CAST(NULL AS BOOLEAN) AS ext_anomalous",
                               *[f"CAST(NULL AS STRING) AS {c}" for c in texts])
    elif "signals" not in rows.columns:
        raise ValueError("external verdicts need the signals of their windows: see with_signals")
    external = "ext_anomalous IS NOT NULL"

    def either(name: str, rule: str) -> str:
        return sql.when(external, name, rule)

    # only the forced kinds' texts go into the summary that replaces an empty one
    forced = sql.is_in("s.kind", fv.FORCED_KINDS)
    forced_text = (f"concat({sql.text(fv.FORCED_SUMMARY)}, array_join(transform(filter(signals,"
                   f" s -> {forced}), s -> s.detail), ' '))") if "signals" in rows.columns else sql.text(fv.FORCED_SUMMARY)
    summary = either("ext_summary", sql.text(fv.RULE_SUMMARY))
    kept = [c for c in rows.columns if not c.startswith("ext_")]
    return rows.selectExpr(
        *kept,
        "forced OR coalesce(ext_anomalous, true) AS anomalous",
        f"CASE WHEN forced THEN 'high' ELSE coalesce({either('ext_severity', 'rule_severity')},"
        " rule_severity) END AS severity",
        f"CASE WHEN forced AND coalesce({summary}, '') = '' THEN {forced_text}"
        f" ELSE {summary} END AS summary",
        f"{either('ext_cause', sql.text(fv.RULE_CAUSE))} AS suspected_cause",
        f"{either('ext_action', sql.text(fv.RULE_ACTION))} AS recommended_action",
        f"{external} AS external_verdict",
    )


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of one (target, signature) after the other, in order: which alert, and which of these ask anew.

    Held are the ends of the last delivered alert and of the last question, so a signature may have any
    number of windows.
    """
    key, last, asked_at = None, None, None
    for batch in batches:
        alerted, asked = [], []
        columns = ("target", "signature", "w_end", "delivered", "cooldown", "verdict_ttl", "stamp", "asked_at")
        for target, signature, end, delivered, pause, ttl, stamp, before in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if (target, signature) != key:
                key, last, asked_at = (target, signature), stamp, before
            fires = last is None or end - last >= pause
            if fires and delivered:
                last = end
            asks = fires and (asked_at is None or end - asked_at >= ttl)
            if asks:
                asked_at = end
            alerted.append(fires)
            asked.append(asks)
        yield pa.record_batch([*(batch.column(c) for c in columns[:3]), pa.array(alerted, pa.bool_()), pa.array(asked, pa.bool_())],
                              names=["target", "signature", "w_end", "alerted", "asked"])


def cooldown(rows: DataFrame, targets: list[Target], earlier: DataFrame | None = None) -> DataFrame:
    """Mark each window as alerted or suppressed by an earlier alert with the same signature, and as `asked` when
    it alerts and no verdict of that signature is younger than the target's limit.

    `earlier` has the delivered alerts of runs before this one: target, signature, w_end, and maybe `asked`.

    Suppressed windows do not extend the pause and undelivered alerts do not start one, so the decision runs
    along the windows of one (target, signature) in order: linear, with two numbers held.
    """
    if "delivered" not in rows.columns:
        rows = rows.selectExpr("*", "true AS delivered")
    keys = ["target", "signature"]
    ends = rows.groupBy(*keys, "w_end").agg(F.expr("bool_or(delivered) AS delivered"))
    stamps = ["CAST(NULL AS BIGINT) AS stamp", "CAST(NULL AS BIGINT) AS asked_at"]
    if earlier is not None:
        asked = "asked" if "asked" in earlier.columns else "true"
        known = earlier.groupBy(*keys).agg(F.expr("max(w_end) AS stamp"), F.expr(f"max(CASE WHEN {asked} THEN w_end END) AS asked_at"))
        ends, stamps = ends.join(known, keys, "left"), ["stamp", "asked_at"]
    line = with_limits(ends, targets).selectExpr(
        *keys, "w_end", "delivered", "CAST(cooldown AS BIGINT) AS cooldown", "CAST(verdict_ttl AS BIGINT) AS verdict_ttl", *stamps)
    line = line.repartition(*keys).sortWithinPartitions(*keys, "w_end")
    decided = line.mapInArrow(_walked, "target STRING, signature STRING, w_end BIGINT, alerted BOOLEAN, asked BOOLEAN")
    return rows.join(decided, [*keys, "w_end"])


def daily_quota(rows: DataFrame, targets: list[Target]) -> DataFrame:
    """Rows numbered within their UTC day over all targets, and whether the number is within what their target
    allows a day.

    Counts of windows are added up along a day, rows are numbered within their window only: a day is no
    task's group of rows.
    """
    dated = rows.selectExpr("*", "CAST(timestamp_seconds(w_end) AS DATE) AS day")
    counts = dated.groupBy("day", "w_end").agg(F.expr("count(*) AS n")).selectExpr(
        "w_end", "coalesce(sum(n) OVER (PARTITION BY day ORDER BY w_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before")
    numbered = dated.selectExpr("*", "row_number() OVER (PARTITION BY w_end ORDER BY target) AS place").join(counts, "w_end")
    return with_limits(numbered.selectExpr(*dated.columns, "before + place AS nth"), targets).selectExpr(
        *dated.columns, "nth", "nth <= per_day AS within_budget", "greatest(0L, per_day - nth) AS remaining")


def assessed(decided: DataFrame, targets: list[Target]) -> DataFrame:
    """Of the alerts, those to be assessed from outside: they ask, and the day's budget of their target has room.

    All others keep the stored verdict if there is one, and the rule verdict if not.
    """
    return daily_quota(decided.where("alerted AND asked"), targets).where("within_budget").select(*decided.columns)


def with_answers(decided: DataFrame, answers: DataFrame, targets: list[Target]) -> DataFrame:
    """Decided rows with the external assessments (target, signature, w_end, ext_*) of those within the budget; a
    row beyond it has no answer, so `verdict` falls back to the rules."""
    ext = [c for c in answers.columns if c.startswith("ext_")]
    keys = ["target", "signature", "w_end"]
    granted = assessed(decided.select(*keys, "alerted", "asked"), targets).select(*keys).join(answers.select(*keys, *ext), keys)
    return decided.drop(*ext).join(granted, keys, "left")


def verdict_asof(rows: DataFrame, verdicts: DataFrame, targets: list[Target]) -> DataFrame:
    """Latest stored verdict of the same (target, signature) younger than the target's limit.

    Both sides are put on one time line and the last verdict is carried forward: no range join.
    `verdicts` has target, signature, ts and ext_* columns; one stored at a window's own end
    counts for it.
    """
    ext = [c for c in verdicts.columns if c.startswith("ext_")]
    stored = verdicts.selectExpr("target", "signature", "ts AS w_end", "0 AS side",
                                 f"struct(ts{''.join(', ' + c for c in ext)}) AS stored")
    line = rows.selectExpr("*", "1 AS side").unionByName(stored, allowMissingColumns=True)
    carried = line.selectExpr(
        *[c for c in line.columns if c != "stored"],
        "last(stored, true) OVER (PARTITION BY target, signature ORDER BY w_end, side"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stored").where("side = 1")
    fresh = "w_end - stored.ts < verdict_ttl"
    return with_limits(carried, targets).selectExpr(
        *rows.columns, f"CASE WHEN {fresh} THEN stored.ts END AS verdict_ts",
        *[f"CASE WHEN {fresh} THEN stored.{c} END AS {c}" for c in ext])
