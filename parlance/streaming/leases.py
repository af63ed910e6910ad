"""Leases as running state: who holds a job, renewed by heartbeats, given back by a timer when they stop.

A queue's table has the jobs; the stream's state has only those that somebody
works on. A job's state ends with its outcome or with its lock, so it doesn't
grow with the jobs that there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.queue import LOCK_SECONDS

#: What a stream of leases must have: kind is lease, heartbeat, complete or fail.
EVENTS = "job_id bigint, kind string, worker string, attempt bigint, at timestamp"
#: What comes out: status is running, completed, failed, pending (the lock is over) or refused (not the holder).
CHANGES = "job_id bigint, status string, worker string, attempt bigint, at timestamp, lock_ends timestamp"


def _stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Holder(StatefulProcessor):
    """The lease of one job: worker, attempt and the time at which the lock is over."""

    def __init__(self, lock_ms: int, event_time: bool) -> None:
        self.lock_ms, self.event_time = lock_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker string, attempt bigint, ends bigint")

    @staticmethod
    def _ended(out: list, job: int, held: tuple) -> None:
        """The job is given back: its lock is over."""
        out.append((job, "pending", held[0], held[1], _stamp(held[2]), None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The lease is read and written once for all of a job's events in a batch, since each look at state goes to the far side."""
        events = pd.concat(list(rows)).sort_values(["at", "kind", "worker"], kind="stable")
        out: list = []
        before = held = tuple(self.lease.get()) if self.lease.exists() else None
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        for e in events.itertuples():
            clock = int(e.at.value // 1_000_000) if now is None else now
            if held is not None and held[2] <= clock:
                self._ended(out, key[0], held)
                held = None
            mine = held is not None and held[0] == e.worker
            if (e.kind == "lease" and held is None) or (e.kind == "heartbeat" and mine):
                held = (e.worker, int(e.attempt) if held is None else held[1], clock + self.lock_ms)
                out.append((key[0], "running", e.worker, held[1], e.at, _stamp(held[2])))
            elif e.kind in ("complete", "fail") and mine:
                out.append((key[0], "completed" if e.kind == "complete" else "failed", e.worker, held[1], e.at, None))
                held = None
            else:
                out.append((key[0], "refused", e.worker, int(e.attempt), e.at, None))
        if held != before:
            if before is not None:
                self.handle.deleteTimer(before[2])
            if held is None:
                self.lease.clear()
            else:
                self.lease.update(held)
                self.handle.registerTimer(held[2])
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list = []
        if self.lease.exists() and self.lease.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            held = tuple(self.lease.get())
            self._ended(out, key[0], held)
            self.handle.deleteTimer(held[2])
            self.lease.clear()
        yield self._frame(out)

    def _frame(self, out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["job_id", "status", "worker", "attempt", "at", "lock_ends"])
        return frame.astype({"at": "datetime64[ns]", "lock_ends": "datetime64[ns]", "attempt": "int64", "job_id": "int64"})

    def close(self) -> None:
        pass


def leases(events: DataFrame, lock_seconds: int = LOCK_SECONDS, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """The changes (CHANGES) that a stream of lease events (EVENTS) makes.

    A job is leased to whom asks first; only the holder renews, completes or
    fails it; ``lock_seconds`` after the last sign of life it is pending again,
    whether or not any event comes. The clock is the machine's, or with
    ``event_time`` the stream's: then locks end with the watermark, ``late``
    behind the newest event, and what comes later still is dropped.
    """
    rows = events.withWatermark("at", late) if event_time else events
    return rows.groupBy("job_id").transformWithStateInPandas(Holder(lock_seconds * 1000, event_time), CHANGES, "Append", "EventTime" if event_time else "ProcessingTime")


def running(changes: DataFrame) -> DataFrame:
    """The leases that a table of changes ends with: each job's last change, if it is running."""
    order = F.struct("at", F.col("lock_ends").isNotNull(), "lock_ends", "status")
    last = changes.where("status <> 'refused'").groupBy("job_id").agg(F.max_by(F.struct("status", "worker", "attempt", "at", "lock_ends"), order).alias("l"))
    return last.where("l.status = 'running'").select("job_id", "l.worker", "l.attempt", "l.lock_ends")
