"""Keyed state of streams with timers: runs by key, a result cache that expires, the status of runs (M1-M3, M5).

The processors need a state store of several columns (RocksDB): see use_store(). Time is event time: a batch's late rows are those behind
the watermark, and timers fire when it passes them, so that replayed files give the same rows and state does not grow with the past.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """Let streams of this session keep their state in RocksDB, which spills to disk and is checkpointed by its changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _millis(at: datetime) -> int:
    """Milliseconds of a timestamp as Spark gives it to Python: in the worker's time zone where it names none."""
    return int(at.timestamp() * 1000)


class _Once(StatefulProcessor):
    """The first row of a key; the key is forgotten `keep` milliseconds after it."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: r.at)
        if not self.seen.exists():
            until = _millis(first.at) + self.keep
            self.seen.update((until,))
            self.handle.registerTimer(until)
            yield Row(key=key[0], at=first.at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def runs_once(requests: DataFrame, keep_seconds: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """(key, at): each run key once, however often its files are replayed, until keep_seconds after its first request (M1, M2).

    requests: a stream of (key, at).
    """
    keyed = requests.select("key", "at").withWatermark("at", delay).groupBy("key")
    return keyed.transformWithState(_Once(keep_seconds * 1000), "key string, at timestamp", "Append", "EventTime")


class _Cache(StatefulProcessor):
    """Requests answered from the last good result of their key, until it is `life` milliseconds old."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value double, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get() if self.held.exists() else None
        before = held[1] if held else None
        for r in sorted(rows, key=lambda r: (r.at, r.kind == "request", r.value is None, r.value or 0.0)):  # of one moment the results first
            now = _millis(r.at)
            if r.kind == "result":
                if r.value is not None and (held is None or now + self.life >= held[1]):
                    held = (r.value, now + self.life)
            elif held is not None and now <= held[1]:
                yield Row(key=key[0], at=r.at, value=held[0], source="cache")
            else:
                yield Row(key=key[0], at=r.at, value=None, source="execute")
        if held is not None and held[1] != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.held.update(held)
            self.handle.registerTimer(held[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_results(rows: DataFrame, life_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """(key, at, value, source): for every request whether the cache answers it, and with what, or it is to be executed (M3).

    rows: a stream of (key, at, kind, value): kind is request, or result with the value that a good execution gave; a result without value is
    a failure, which is not kept. A result answers until it is life_seconds old; then its state goes.
    """
    keyed = rows.select("key", "at", "kind", "value").withWatermark("at", delay).groupBy("key")
    return keyed.transformWithState(_Cache(life_seconds * 1000), "key string, at timestamp, value double, source string", "Append", "EventTime")


class _Status(StatefulProcessor):
    """The status of a job by the events of its runs; a state that is over is forgotten `keep` milliseconds later."""

    NAMES = {"STARTED": "running", "SUCCESS": "complete", "FAILURE": "failed", "CANCELED": "cancelled"}
    OVER = ("complete", "failed", "cancelled")

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("status", "status string, at long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, last, timer = self.held.get() if self.held.exists() else (None, -1, None)
        for r in sorted(rows, key=lambda r: (r.at, r.event)):
            new, now = self.NAMES.get(r.event), _millis(r.at)
            if new is None or now < last or new == status or status in self.OVER and new == "running":
                continue
            status, last = new, now
            yield Row(key=key[0], at=r.at, status=status)
        if status is None:
            return
        until = last + self.keep if status in self.OVER else None
        if timer != until and timer is not None:
            self.handle.deleteTimer(timer)
        if timer != until and until is not None:
            self.handle.registerTimer(until)
        self.held.update((status, last, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def run_statuses(events: DataFrame, keep_seconds: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """(key, at, status): every change of a job's status by its run events STARTED, SUCCESS, FAILURE, CANCELED (M5).

    events: a stream of (key, at, event). Repeated and older events change nothing, and a job that is over does not start again until
    keep_seconds later, when it is forgotten.
    """
    keyed = events.select("key", "at", "event").withWatermark("at", delay).groupBy("key")
    return keyed.transformWithState(_Status(keep_seconds * 1000), "key string, at timestamp, status string", "Append", "EventTime")
