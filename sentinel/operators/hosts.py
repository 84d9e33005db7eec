"""Host logs: failed logins, memory kills, disk and unit failures, silent hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sentinel.config import Span, Target, with_limits
from sentinel.operators import signals
from sentinel.operators.facts import HOST_PHRASES
from sentinel.operators.windows import assign, sides

PHRASE_KINDS = {
    "linux_ssh_bruteforce": ("ssh_fail", "ssh_threshold"),
    "linux_oom": ("oom", "oom_threshold"),
    "linux_disk_errors": ("disk", "disk_threshold"),
    "linux_unit_failures": ("unit_fail", "unit_threshold"),
}
HOST_KINDS = (*PHRASE_KINDS, "linux_host_silent")


def watched(targets: list[Target]) -> list[Target]:
    return [t for t in targets if t.linux_check and t.linux_indices]


def host_windows(hosts: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    """Per host: rows and phrase hits of the window, rows of the window right before it.

    A host that is missing now still has a row, from its previous window.
    """
    rows = assign(hosts, watched(targets), span, offset=lambda t: t.window,
                  indices=lambda t: t.linux_indices)
    return rows.groupBy("target", "w_end", "host").agg(
        *sides("total", "total"), *[sides(name, name)[0] for name in HOST_PHRASES])


def host_signals(windows: DataFrame, targets: list[Target],
                 kinds: tuple[str, ...] = HOST_KINDS) -> DataFrame:
    found = {
        # a host without rows in the current window has no phrase counts to test
        kind: (f"total > 0 AND {measure} >= {threshold}",
               signals.signal(kind, cur=measure, threshold=threshold, entity="host",
                              hours="hours"))
        for kind, (measure, threshold) in PHRASE_KINDS.items()
    }
    found["linux_host_silent"] = (
        "check_host_silent AND base_total > 0 AND base_total >= silent_min_docs AND total = 0",
        signals.signal("linux_host_silent", cur="total", base="base_total",
                       threshold="silent_min_docs", entity="host", hours="hours"),
    )
    return signals.emit(with_limits(windows, targets), *[found[kind] for kind in kinds])
