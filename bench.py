"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`replay_signals` evaluates every window of three targets at once. `window_loop` is what it replaces:
the same detectors called for one window after the other, measured on a few windows and reported
per window, next to the per-window time of the replay.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "error_spike", "warn_spike", "new_errors", "index_silent", "heartbeat_missing", "access_by_ip",
    "suspicious_requests", "host_counts", "all_signals", "replay_signals", "alert_documents",
    "digest", "scrub_table", "fingerprint_rollup", "normalize_logs",
]
LOOP_WINDOWS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from registry import settings as cfg
    from registry.queries import QUERIES, logs
    from sentinel.config import Span
    from sentinel.plans.watch import Watch

    def timed(run) -> float:
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timed(lambda: QUERIES["window_totals"](spark, folder))  # start-up
    times = {}
    for name in HEADLINE:
        times[name] = min(timed(lambda: QUERIES[name](spark, folder)) for _ in range(2))

    step = cfg.MAIN[0].window
    ends = [cfg.SPAN.start + step * (i + 40) for i in range(LOOP_WINDOWS)]
    loop = [timed(lambda: Watch(logs(spark, folder), cfg.MAIN, Span(end, None, end)).signals())
            for end in ends]
    windows = (cfg.SPAN.end - cfg.SPAN.start) // step
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "windows": windows,
        "per_window_replay_sec": round(times["all_signals"] / windows, 4),
        "per_window_loop_sec": round(sum(loop) / len(loop), 4),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
