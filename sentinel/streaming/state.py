"""Keyed state for streams: cooldown, first seen, missing heartbeats.

A key is a (target, signature), (target, fingerprint) or (target, service); its rows are windows or
minutes, never raw log rows. The state lives in Spark's state store and survives lost executors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentinel.config import Target, with_limits
from sentinel.functions import fixed_values as fv
from sentinel.streaming.jobs import with_clock, with_event_time

# seconds by which windows of one key may arrive out of order
LATENESS = 86400
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# The processors travel with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_state_store(spark) -> None:
    """Keyed state with timers and expiry needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _ordered(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class _InOrder(StatefulProcessor):
    """Windows of a key decided in the order of their ends, however they arrive.

    A window waits, keyed by its end, until the watermark has passed it; a timer then walks those that are
    due. What is kept besides is one second, dropped by the event clock once it cannot matter any more.
    """

    value = "delivered BOOLEAN, pause BIGINT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "w_end BIGINT", self.value)
        self.last = handle.getValueState("last", "second BIGINT, forget BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for end, value in zip(frame.w_end.tolist(), self.values(frame), strict=True):
                if not self.waiting.containsKey((end,)):
                    self.handle.registerTimer(end * 1000)
                self.waiting.updateValue((end,), value)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], v) for k, v in self.waiting.iterator() if k[0] * 1000 <= now)
        last, forget = self.last.get() if self.last.exists() else (None, None)
        before, out = last, []
        for end, value in due:
            last = self.decide(last, end, value, out)
            self.waiting.removeKey((end,))
        if last is not None and last != before:
            if forget is not None:
                self.handle.deleteTimer(forget)
            forget = (last + self.keep(due)) * 1000
            self.last.update((last, forget))
            self.handle.registerTimer(forget)
        elif forget is not None and forget <= now:
            self.last.clear()
        if out:
            yield self.frame(key, out)

    def close(self) -> None:
        pass


class CooldownState(_InOrder):
    """Same rule as the batch cooldown: strict age, only delivered alerts start a pause."""

    def values(self, frame: pd.DataFrame) -> list[tuple]:
        return list(zip(frame.delivered.tolist(), frame.cooldown.tolist(), strict=True))

    def decide(self, last: int | None, end: int, value: tuple, out: list) -> int | None:
        delivered, pause = value
        fires = last is None or end - last >= pause
        out.append((end, delivered, fires))
        return end if fires and delivered else last

    def keep(self, due: list) -> int:
        return due[-1][1][1]

    def frame(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"target": [key[0]] * len(out), "signature": [key[1]] * len(out),
                             "w_end": pd.Series([e for e, _, _ in out], dtype="int64"),
                             "delivered": pd.Series([d for _, d, _ in out], dtype="bool"),
                             "alerted": pd.Series([a for _, _, a in out], dtype="bool")})


class FirstSeenState(_InOrder):
    """New when never seen, or not within the retention; every sighting renews it."""

    value = "seen BOOLEAN"
    retention = fv.SEEN_RETENTION

    def values(self, frame: pd.DataFrame) -> list[tuple]:
        return [(True,)] * len(frame)

    def decide(self, last: int | None, end: int, value: tuple, out: list) -> int:
        if last is None or end - last > self.retention:
            out.append(end)
        return end

    def keep(self, due: list) -> int:
        return self.retention + 1  # an age equal to the retention still counts as known

    def frame(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"target": [key[0]] * len(out), "fp": [key[1]] * len(out), "w_end": pd.Series(out, dtype="int64")})


class HeartbeatState(StatefulProcessor):
    """One row for each silence that became too long, however the stream is cut into batches.

    Expected services begin with a state and a timer, so one that never speaks is told of, too, without a last
    sign of life. A silence shows up between two signs of life of a batch, or when the event clock passes the
    last one plus the allowed time; `reported` keeps the two from both telling of the same one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms BIGINT, staleness BIGINT, reported BOOLEAN, heard BOOLEAN")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        start, staleness = int(initialState.start.iloc[0]) * 1000, int(initialState.staleness.iloc[0])
        self.last.update((start, staleness, False, False))
        self.handle.registerTimer(start + staleness * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows, "last_ts")
        last, _, reported, spoke = self.last.get() if self.last.exists() else (None, None, False, False)
        missing = []
        for ts, staleness in zip(frame.last_ts, frame.staleness):
            heard = int(ts.timestamp() * 1000)
            if last is not None and heard - last > staleness * 1000 and not reported:
                missing.append((last, int(staleness), spoke))
            if last is None or heard > last:
                last, reported, spoke = heard, False, True
        staleness = int(frame.staleness.iloc[-1])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.last.update((last, staleness, reported, spoke))
        self.handle.registerTimer(last + staleness * 1000)
        if missing:
            yield self._rows(key, missing)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, staleness, reported, spoke = self.last.get()
        self.last.update((last, staleness, True, spoke))
        if not reported:
            yield self._rows(key, [(last, staleness, spoke)])

    @staticmethod
    def _rows(key, missing: list[tuple[int, int, bool]]) -> pd.DataFrame:
        return pd.DataFrame({
            "target": [key[0]] * len(missing), "service": [key[1]] * len(missing),
            "last_second": pd.Series([ms // 1000 if spoke else None for ms, _, spoke in missing], dtype="Int64"),
            "missing_since": pd.Series([ms // 1000 + s for ms, s, _ in missing], dtype="int64"),
        })

    def close(self) -> None:
        pass


def _on_event_clock(windows: DataFrame, lateness: int, clock: str | None) -> DataFrame:
    rows = windows.selectExpr("*", "CAST(timestamp_seconds(w_end) AS TIMESTAMP_NTZ) AS ts")
    rows = with_clock(rows, clock) if clock else rows
    return with_event_time(rows, lateness).where("w_end IS NOT NULL")


def cooldown(windows: DataFrame, targets: list[Target], lateness: int = LATENESS, clock: str | None = None) -> DataFrame:
    """Stream of (target, signature, w_end, delivered), each marked alerted or suppressed once the watermark has
    passed it. A clock lets it pass the last ones."""
    rows = with_limits(windows, targets).select("target", "signature", "w_end", "delivered",
                                                "cooldown")
    return _on_event_clock(rows, lateness, clock).groupBy("target", "signature") \
        .transformWithStateInPandas(
            CooldownState(), "target STRING, signature STRING, w_end BIGINT, delivered BOOLEAN,"
            " alerted BOOLEAN", "Append", "EventTime")


def first_seen(fingerprints: DataFrame, lateness: int = LATENESS, clock: str | None = None) -> DataFrame:
    """Stream of (target, fp, w_end), only the first sightings."""
    return _on_event_clock(fingerprints, lateness, clock).groupBy("target", "fp") \
        .transformWithStateInPandas(
            FirstSeenState(), "target STRING, fp STRING, w_end BIGINT", "Append", "EventTime")


def expected_services(spark, targets: list[Target], start: int) -> DataFrame:
    """(target, service, staleness, start) of all configured checks: silence counts from `start` on."""
    rows = [(t.name, service, t.staleness, start) for t in targets for service, _, _ in t.heartbeats]
    return spark.createDataFrame(rows, "target STRING, service STRING, staleness BIGINT, start BIGINT").dropDuplicates(["target", "service"])


def missing_heartbeats(minutes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Stream of `heartbeat_minutes`, one row for each silence that became too long; with the expected services
    also that of one that never spoke."""
    keys = ["target", "service"]
    return minutes.groupBy(*keys).transformWithStateInPandas(
        HeartbeatState(), "target STRING, service STRING, last_second BIGINT,"
        " missing_since BIGINT", "Append", "EventTime", expected.groupBy(*keys) if expected is not None else None)
