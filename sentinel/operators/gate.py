"""Level, template and ingestion rules: the gate every window passes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.config import Span, Target, with_limits
from sentinel.functions import fixed_values as fv
from sentinel.functions import sql, text
from sentinel.operators import signals
from sentinel.operators.windows import (
    assign,
    per_target,
    sides,
    spine,
    top_k,
)

GATE_KINDS = ("error_spike", "warn_spike", "fatal", "ingestion_stopped")
# Latest earlier window of the same target that had this fingerprint.
LAST_SEEN = ("max(CASE WHEN seen THEN w_end END) OVER (PARTITION BY target, fp ORDER BY w_end"
             " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seen")
# Seen before and not yet forgotten.
KNOWN = f"coalesce(w_end - last_seen <= {fv.SEEN_RETENTION}L, false)"


def _baseline(t: Target) -> int:
    return t.baseline_offset


def level_windows(counts: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    """Current and baseline count of each level; the union of both windows' levels."""
    rows = assign(counts.where("level IS NOT NULL"), targets, span, offset=_baseline)
    return (rows.groupBy("target", "w_end", "level").agg(*sides("n", "cur"))
            .withColumnRenamed("base_cur", "base"))


def window_counts(counts: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    """One row per evaluated window: totals, errors, warnings, fatals with their baselines.

    Empty windows are there too, with zeros.
    """
    rows = assign(counts, targets, span, offset=_baseline, extra=lambda t: {
        "is_err": sql.is_in("level", t.error_levels),
        "is_warn": sql.is_in("level", t.warn_levels),
        "is_fatal": sql.is_in("level", t.fatal_levels),
    })
    rows = rows.unionByName(spine(counts.sparkSession, targets, span), allowMissingColumns=True)
    return rows.groupBy("target", "w_end").agg(
        *sides("n", "total"), *sides("n", "err", "is_err"), *sides("n", "warn", "is_warn"),
        *sides("n", "fatal", "is_fatal"))


def _reported(t: Target) -> str:
    return sql.is_in("level", [*t.error_levels, *t.warn_levels])


def top_messages(messages: DataFrame, targets: list[Target], span: Span,
                 k: int | None = fv.TOP_MESSAGES) -> DataFrame:
    """Most frequent raw templates over error and warning levels, per window: a list to look at."""
    rows = assign(messages, targets, span, keep=_reported)
    return top_k(rows.groupBy("target", "w_end", "message").agg(F.expr("sum(n) AS n")),
                 ["target", "w_end"], ["n DESC", "message ASC"], k)


def message_windows(messages: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    """Every raw template over error and warning levels, per window and its baseline.

    Where baselines are whole windows of the same grid a window is summed once, and its sums are
    repeated for the window that they are the baseline of.
    """
    window = ["target", "w_end"]
    if any(t.baseline_offset % t.window for t in targets):
        rows = assign(messages, targets, span, keep=_reported, offset=_baseline)
        return _listed(rows.groupBy(*window, "is_base", "message").agg(F.expr("sum(n) AS n")), targets)

    rows = assign(messages, targets, span, keep=_reported, lead=_baseline)
    summed = rows.groupBy(*window, "message").agg(F.expr("sum(n) AS n"))
    later = f"(w_end + {per_target(targets, lambda t: f'{t.baseline_offset}L')})"
    uses = sql.compact([
        sql.when(per_target(targets, lambda t: span.covers(end, t.window), "false"),
                 sql.struct(w_end=end, is_base=sql.literal(is_base)))
        for end, is_base in (("w_end", False), (later, True))
    ])
    return _listed(summed.selectExpr("target", "message", "n", f"inline({uses})"), targets)


def _listed(rows: DataFrame, targets: list[Target]) -> DataFrame:
    """Only the most frequent templates for targets that set a limit."""
    limited = [t for t in targets if t.template_limit is not None]
    if not limited:
        return rows
    capped = sql.is_in("target", [t.name for t in limited])
    ranked = top_k(rows.where(capped), ["target", "w_end", "is_base"], ["n DESC", "message ASC"],
                   max(t.template_limit for t in limited))
    own = per_target(limited, lambda t: f"rank <= {t.template_limit}", "false")
    return ranked.where(own).drop("rank").unionByName(rows.where(f"NOT {capped}"))


def scrubbed_windows(messages: DataFrame, targets: list[Target], done: bool = False) -> DataFrame:
    """Redact all templates, add up those that became equal, mark the ignored ones. `done`: they are redacted."""
    # one redaction expression for all targets that want it
    scrubbed = sql.is_in("target", [t.name for t in targets if t.scrub_pii])

    def ignored(t: Target) -> str:
        clean = text.scrub if t.scrub_pii else (lambda pattern: pattern)
        return sql.any_of([f"contains(lower(message), lower({clean(sql.text(p))}))"
                           for p in t.warn_spike_ignore])

    shown = sql.when(scrubbed, text.scrub("message"), "message")
    marked = f"{per_target(targets, ignored, 'false')} AS ignored"
    if done:  # equal ones of a window and side are one row already
        return messages.selectExpr("target", "w_end", "is_base", "message", "n", marked)
    return (
        messages.selectExpr("target", "w_end", "is_base", f"{shown} AS message", "n")
        .groupBy("target", "w_end", "is_base", "message")
        .agg(F.expr("sum(n) AS n"))
        .selectExpr("*", marked)
    )


def with_ignored(windows: DataFrame, templates: DataFrame) -> DataFrame:
    """Add what the ignore list takes away from each window's and baseline's warnings."""
    counts = templates.groupBy("target", "w_end").agg(
        *sides("n", "ignored_n", "ignored"), F.expr("count_if(NOT is_base) AS n_templates"))
    return windows.join(counts, ["target", "w_end"], "left").selectExpr(
        *windows.columns, "coalesce(ignored_n, 0L) AS ignored",
        "coalesce(base_ignored_n, 0L) AS base_ignored", "coalesce(n_templates, 0L) AS n_templates")


def ignore_degraded(windows: DataFrame, targets: list[Target]) -> DataFrame:
    """Windows where the ignore list cannot be trusted: warnings, but no templates at all, or as many as
    the target's limit lets through."""
    uses_ignore = sql.is_in("target", [t.name for t in targets
                                       if t.warn_spike_ignore and t.alert_on_warn_spike])
    limit = per_target([t for t in targets if t.template_limit is not None], lambda t: str(t.template_limit))
    reason = (f"CASE WHEN n_templates = 0 THEN 'no templates'"
              f" WHEN n_templates >= {limit} THEN 'template list full' END")
    return (windows.where(f"{uses_ignore} AND warn > 0")
            .selectExpr("target", "w_end", "warn", "n_templates", f"{reason} AS reason")
            .where("reason IS NOT NULL"))


def gate_signals(windows: DataFrame, targets: list[Target],
                 kinds: tuple[str, ...] = GATE_KINDS) -> DataFrame:
    """error_spike, warn_spike (needs `with_ignored`), fatal, ingestion_stopped."""
    rows = with_limits(windows, targets)
    if "warn_spike" in kinds:
        rows = rows.selectExpr("*", "greatest(0L, warn - ignored) AS loud",
                               "greatest(0L, base_warn - base_ignored) AS base_loud")
    suffix = sql.when("ignored > 0", sql.fill(fv.DETAIL["warn_spike_ignored"], ignored="ignored"),
                      "''")
    warn_text = sql.fill(fv.DETAIL["warn_spike"], cur="loud", base="base_loud",
                         factor="warn_factor_text")
    found = {
        "error_spike": (
            "err >= min_errors AND err >= base_err * error_factor",
            signals.signal("error_spike", cur="err", base="base_err", threshold="error_factor",
                           factor="error_factor_text"),
        ),
        "warn_spike": (
            "check_warnings AND loud >= min_warnings AND loud >= base_loud * warn_factor",
            signals.signal("warn_spike", cur="loud", base="base_loud", threshold="warn_factor",
                           extra="array(CAST(ignored AS STRING))",
                           detail=f"concat({warn_text}, {suffix})"),
        ),
        "fatal": ("fatal > 0", signals.signal("fatal", cur="fatal")),
        "ingestion_stopped": (
            "check_ingestion AND base_total >= min_errors AND total = 0",
            signals.signal("ingestion_stopped", cur="total", base="base_total",
                           threshold="min_errors"),
        ),
    }
    return signals.emit(rows, *[found[k] for k in kinds])


def window_fingerprints(templates: DataFrame) -> DataFrame:
    """Fingerprints of a window: in the current one, in the baseline, seen at all (also ignored)."""
    return (
        templates.selectExpr("target", "w_end", "is_base", "ignored",
                             f"{text.fingerprint('message')} AS fp")
        .groupBy("target", "w_end", "fp")
        .agg(F.expr("bool_or(NOT is_base AND NOT ignored) AS in_current"),
             F.expr("bool_or(is_base AND NOT ignored) AS in_baseline"),
             F.expr("bool_or(NOT is_base) AS seen"))
    )


def new_error_signals(templates: DataFrame, targets: list[Target], live: bool = False,
                      known: DataFrame | None = None) -> DataFrame:
    """Fingerprints absent from the baseline; with `live` also never seen in earlier windows, be it of this
    run or, with `known` (target, fp, last_seen), of runs before it.

    They are counted in full; only the few that the text shows are gathered.
    """
    wanted = sql.is_in("target", [t.name for t in targets if t.alert_on_new_signatures])
    fps = window_fingerprints(templates).where(wanted)
    fresh = "in_current AND NOT in_baseline"
    if live:
        fps = fps.selectExpr("*", LAST_SEEN)
        if known is not None:
            before = known.groupBy("target", "fp").agg(F.expr("max(last_seen) AS seen_before"))
            fps = fps.join(before, ["target", "fp"], "left").withColumn(
                "last_seen", F.expr("greatest(last_seen, seen_before)"))
        fresh += f" AND NOT {KNOWN}"
    fps = fps.where(fresh).select("target", "w_end", "fp")
    window = ["target", "w_end"]
    shown = top_k(fps, window, ["fp ASC"], fv.SHOWN_FINGERPRINTS).groupBy(*window).agg(
        F.expr("array_sort(collect_list(fp)) AS shown"))
    rows = fps.groupBy(*window).agg(F.expr("count(*) AS new")).join(shown, window)
    return signals.emit(rows, ("true", signals.signal(
        "new_errors", cur="new", extra="shown", shown="array_join(shown, '; ')")))


def error_samples(rows: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    """Newest error rows of each window, cut to a fixed length, empty ones dropped afterwards."""
    hits = assign(rows.select("bucket", "index_name", "level", "ts", "event_id", "message"),
                  targets, span, keep=lambda t: sql.is_in("level", t.error_levels))
    ranked = top_k(hits, ["target", "w_end"], ["ts DESC", "event_id DESC"],
                   max(t.sample_size for t in targets))
    size = per_target(targets, lambda t: str(t.sample_size), "0")
    return (
        ranked.where(f"rank <= {size}")
        .selectExpr("target", "w_end", "rank", "ts", "event_id",
                    f"substr(message, 1, {fv.SAMPLE_CHARS}) AS sample")
        .where("sample IS NOT NULL AND sample <> ''")
    )
