"""Targets and thresholds the registered queries run with, scaled to the test tables."""

from dataclasses import replace

from sentinel.config import Span, targets_from

START, END = "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z"
SPAN = Span.replay(START, END)
DIGEST_DAYS = 1
DUE_DAYS, DUE_HOUR = 2, 7
REPORT_FROM, REPORT_TO = "2024-01-08T06:00:00Z", "2024-01-21T12:00:00Z"
MIDDLE = "2024-01-16T00:00:00Z"

_EVERYTHING = ["api-logs-*", "crawler-logs-*", "web-logs-*", "bot-logs"]
_DOCUMENT = {
    "defaults": {
        "min_errors": 5, "error_spike_factor": 2.0, "min_warnings": 10, "warn_spike_factor": 1.5,
        "warn_spike_ignore": "curl exited", "security_scan_min_4xx": 5,
        "security_scan_min_paths": 8, "security_auth_fail_threshold": 4, "linux_indices": "*",
        "linux_ssh_fail_threshold": 3, "linux_unit_fail_threshold": 3,
    },
    "targets": [
        {"name": "main", "indices": _EVERYTHING, "heartbeat_max_staleness_minutes": 360,
         "heartbeat_checks": "api=api-logs-*=Heartbeat: api,"
                             "crawler=crawler-logs-*=Heartbeat: crawler,"
                             "web=web-logs-*=Heartbeat: web,bot=bot-logs=Heartbeat: bot"},
        {"name": "platform", "indices": "api-logs-*,web-logs-*", "baseline_mode": "yesterday",
         "min_errors": 3, "error_spike_factor": 1.5, "min_warnings": 5, "linux_check": False,
         "warn_spike_ignore": "", "index_silent_window_hours": 12},
        {"name": "robots", "indices": "crawler-logs-*,bot-logs", "baseline_mode": "last_week",
         "window_hours": 12, "security_check": False, "linux_indices": "bot-logs",
         "linux_oom_threshold": 2, "linux_disk_error_threshold": 2},
        {"name": "calm", "indices": _EVERYTHING, "error_spike_factor": 3.0, "min_warnings": 20,
         "warn_spike_factor": 3.0, "security_scan_min_4xx": 40, "security_scan_min_paths": 15,
         "security_auth_fail_threshold": 25, "security_min_suspicious": 8,
         "linux_ssh_fail_threshold": 20, "linux_oom_threshold": 5,
         "linux_disk_error_threshold": 5, "linux_unit_fail_threshold": 10,
         "alert_on_new_signatures": False},
    ],
}
TARGETS = {t.name: t for t in targets_from(_DOCUMENT)}
MAIN = [TARGETS["main"]]
#: Expects a service that no row is from.
GHOST = [replace(TARGETS["main"], heartbeat_checks=[*TARGETS["main"].heartbeat_checks, "ghost=api-logs-*=Heartbeat: ghost"])]
STREAM_FILES = 4
LISTED = [replace(TARGETS["main"], template_limit=15)]
MULTI = [TARGETS["main"], TARGETS["platform"], TARGETS["robots"]]
QUOTA = 2
#: Their logs name level and text differently.
NAMED = targets_from({
    "defaults": {**_DOCUMENT["defaults"], "security_check": False, "linux_check": False, "ingestion_drop_check": False},
    "targets": [{"name": "plain", "indices": _EVERYTHING},
                {"name": "edge", "indices": "api-logs-*,web-logs-*", "level_field": "edge.level.keyword",
                 "message_field": "extra.text", "min_errors": 3, "min_warnings": 4}]})
CALM = [replace(TARGETS["calm"], assessments_per_day=QUOTA)]
MODES = [targets_from({"defaults": {"indices": _EVERYTHING}, "targets": [
    {"name": mode, "baseline_mode": mode}]})[0] for mode in ("previous", "yesterday", "last_week")]

COVERAGE_FIELDS = ["level", "index_name", "host", "service", "status_code", "source_ip", "logger",
                   "message_template"]
RETENTION_NOW = "2024-01-31T00:00:00Z"
SCAN_INDICES = ["web-logs-*", "api-logs-2024.01", "-bot-logs"]
SCAN_FROM, SCAN_TO = "2024-01-09T18:00:00Z", "2024-01-11T06:30:00Z"
