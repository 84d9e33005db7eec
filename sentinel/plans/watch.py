"""The whole evaluation: all targets, all windows, all detectors in one job.

`Watch` reads raw logs for lines and for requests, and once more for heartbeats where targets expect any. It
writes lines and requests as fact tables to the shared work folder and lets every detector start from those.
Replaying a year and checking only the latest window are the same call with another `Span`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.config import Span, Target, bucket_seconds
from sentinel.operators import access, facts, gate, history, hosts, incidents, signals, silence
from sentinel.session import materialize
from sentinel.sources.logs import conform


class Evaluation:
    """What follows from signals, windows and templates of any set of targets.

    Needs `targets`, `span`, `written`, `templates`, `window_counts`, `levels` and `signals`.
    """

    def seen(self, known: DataFrame | None = None) -> DataFrame:
        """(target, fp, last_seen) after these windows, without what is to be forgotten by their end."""
        batch = gate.window_fingerprints(self.templates).where("seen")
        return history.merge_seen(known, batch, self.span.end)

    def written_signals(self, heartbeats: bool = True, live: bool = False, known: DataFrame | None = None) -> DataFrame:
        found = self.signals(heartbeats, live, known)
        return materialize(found, "signals") if self.written else found

    def decided(self, found: DataFrame, verdicts: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
        """Incidents with verdicts, each marked alerted or suppressed by the cooldown."""
        rows = incidents.incidents(found, self.targets)
        if verdicts is not None:
            rows = incidents.verdict_asof(rows, verdicts, self.targets).drop("verdict_ts")
            rows = incidents.with_signals(rows, found, self.targets)
        return incidents.cooldown(incidents.verdict(rows), self.targets, earlier)

    def alerts(self, found: DataFrame, verdicts: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
        return self.decided(found, verdicts, earlier).where("alerted AND anomalous")

    def documents(self, alerts: DataFrame, found: DataFrame) -> DataFrame:
        """Alerts as stored documents; `found` are the signals they came from."""
        if self.written:
            alerts = materialize(alerts, "alerts")
        if "signals" not in alerts.columns:
            theirs = found.join(alerts.select("target", "w_end"), ["target", "w_end"], "left_semi")
            alerts = incidents.with_signals(alerts, theirs, self.targets)
        return history.alert_documents(alerts, self.levels, self.window_counts, self.templates,
                                       self.targets)


class Watch(Evaluation):
    """One evaluation over one log table.

    With `written` the facts are tables: written when a result that needs them is built, then read by every
    detector. Without it each result stays a single lazy plan over the logs, which suits a single detector.
    `periods` are lengths in seconds that buckets must divide besides the targets' own. `raw_templates` keeps
    templates as they came in the written facts, for top lists that rank them before redaction; else they are
    redacted before they are first summed, where all targets want that.
    """

    def __init__(self, logs: DataFrame, targets: list[Target], span: Span, written: bool = False,
                 periods: tuple[int, ...] = (), raw_templates: bool = False):
        self.logs, self.targets, self.span = logs, targets, span
        self.written = written
        self.redacted = facts.redacted_alike(targets) and not raw_templates
        self.step = bucket_seconds(targets, periods)
        self.rows = facts.prepare(logs, targets, span, periods)

    # ---- facts ----
    @cached_property
    def lines(self) -> DataFrame:
        """What line-based facts are summed from: a written table, or the raw rows themselves."""
        if not self.written:
            return self.rows
        return materialize(facts.line_facts(self.rows, self.targets, self.redacted), "lines")

    # Windows are summed from facts, so raw rows are not repeated for each target.
    @cached_property
    def counts(self) -> DataFrame:
        if self.written:
            return self.lines.select("bucket", "index_name", "level", "n")
        return facts.count_facts(self.rows)

    @cached_property
    def messages(self) -> DataFrame:
        """Raw templates; logs are read once more where the written facts hold redacted ones."""
        if self.written and not self.redacted:
            return facts.message_rows(self.lines, self.targets)
        return facts.message_facts(self.rows, self.targets)

    @cached_property
    def redacted_messages(self) -> DataFrame:
        """Templates as windows compare them, redacted already if `redacted`."""
        if not self.redacted:
            return self.messages
        if self.written:
            return facts.message_rows(self.lines, self.targets)
        return facts.message_facts(self.rows, self.targets, redacted=True)

    @cached_property
    def host_facts(self) -> DataFrame:
        if self.written:
            return self.lines.where("host IS NOT NULL").select(
                "bucket", "index_name", "host", F.col("n").alias("total"), *facts.HOST_PHRASES)
        return facts.host_facts(self.rows)

    @cached_property
    def access(self) -> DataFrame:
        if self.written:
            return materialize(facts.access_facts(self.rows), "access")
        return facts.access_facts(self.rows)

    # ---- windows ----
    @cached_property
    def templates(self) -> DataFrame:
        windows = gate.message_windows(self.redacted_messages, self.targets, self.span)
        rows = gate.scrubbed_windows(windows, self.targets, done=self.redacted)
        return materialize(rows, "templates") if self.written else rows

    @cached_property
    def window_counts(self) -> DataFrame:
        return gate.window_counts(self.counts, self.targets, self.span)

    @cached_property
    def windows(self) -> DataFrame:
        return gate.with_ignored(self.window_counts, self.templates)

    @cached_property
    def levels(self) -> DataFrame:
        return gate.level_windows(self.counts, self.targets, self.span)

    @cached_property
    def requests(self) -> DataFrame:
        return access.request_windows(self.access, self.targets, self.span)

    @cached_property
    def host_windows(self) -> DataFrame:
        return hosts.host_windows(self.host_facts, self.targets, self.span)

    # ---- signals ----
    def signals(self, heartbeats: bool = True, live: bool = False, known: DataFrame | None = None) -> DataFrame:
        """Union of all detectors. Replays leave out heartbeats and remember no fingerprints; a live cycle gets
        the table of `known` ones and hands `seen` on to the next."""
        targets, span = self.targets, self.span
        parts = [gate.gate_signals(self.windows, targets),
                 gate.new_error_signals(self.templates, targets, live=live, known=known)]
        if any(t.silence_window for t in targets):
            parts.append(silence.index_silent_signals(self.counts, targets, span, self.step))
        if heartbeats and any(t.heartbeats for t in targets):
            parts.append(silence.heartbeat_signals(self.rows, targets, span))
        if access.watched(targets):
            parts.append(access.suspicious_signals(
                access.suspicious_requests(self.requests), targets))
            parts.append(access.client_signals(
                access.access_by_ip(self.requests), targets))
        if hosts.watched(targets):
            parts.append(hosts.host_signals(self.host_windows, targets))
        return signals.union(parts)


class Fleet(Evaluation):
    """Targets whose logs name their fields differently: one `Watch` for each set of names, their results together.

    `source` has its own columns; `names` hold for all targets, a target's `field_names` win. Logs are read once
    more for each further set of names, with only the columns that it needs. Cooldown, verdicts, quota and the
    table of known fingerprints run over all targets at once.
    """

    def __init__(self, source: DataFrame, targets: list[Target], span: Span, names: dict[str, str] | None = None,
                 written: bool = False, **options):
        self.targets, self.span, self.written = targets, span, written
        groups: dict[tuple, list[Target]] = {}
        for t in targets:
            groups.setdefault(tuple(sorted({**(names or {}), **t.field_names}.items())), []).append(t)
        self.watches = [Watch(conform(source, dict(key)), group, span, written, **options) for key, group in groups.items()]

    @cached_property
    def templates(self) -> DataFrame:
        return signals.union([w.templates for w in self.watches])

    @cached_property
    def window_counts(self) -> DataFrame:
        return signals.union([w.window_counts for w in self.watches])

    @cached_property
    def levels(self) -> DataFrame:
        return signals.union([w.levels for w in self.watches])

    def signals(self, heartbeats: bool = True, live: bool = False, known: DataFrame | None = None) -> DataFrame:
        return signals.union([w.signals(heartbeats, live, known) for w in self.watches])


def flat(found: DataFrame) -> DataFrame:
    """Signals for display: plain timestamps, the extra values as one text."""
    return found.selectExpr(
        "target", f"{facts.as_timestamp('w_end')} AS w_end", "kind", "severity", "entity", "cur",
        "base", "threshold", "array_join(extra, ';') AS extra", "detail")
