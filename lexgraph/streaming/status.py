"""SM-02: the status of every ingestion task as keyed state of a stream.

Events (task_id, kind, at, units, error) of a task, in any order and possibly repeated, become its status: ``pending`` when it is submitted, ``processing`` with counts while batches of units succeed or fail, ``completed`` or ``failed``
at its end. A task that says nothing for ``patience`` of event time is failed by a timer; a later event of it is counted, but a status that has ended stays. State survives restarts from the checkpoint; every change of a
status is emitted once, numbered per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from lexgraph.storage import with_workers

#: What may happen to a task, and the error of one that nothing more is heard of.
SUBMITTED, STARTED, SUCCEEDED, FAILED_UNITS, FINISHED, BROKEN = "submitted", "started", "succeeded", "failed_units", "finished", "broken"
SILENT = "no event within the expected time"
ENDED = ("completed", "failed")
STATE = "status string, successful long, failed long, error string, version long, first_ms long, last_ms long"
CHANGES = "task_id string, version long, status string, successful_units long, failed_units long, processed_units long, elapsed_ms long, error string"
_FIRST = ("pending", 0, 0, None, 0, None, None)


def applied(state: tuple, event: tuple) -> tuple:
    """One event (ms, kind, units, error) on a state. Units are counted after the end, too."""
    status, good, bad, error, version, first, last = state
    ms, kind, units, told = event
    first, last = (ms, ms) if first is None else (min(first, ms), max(last, ms))
    good, bad = good + (units if kind == SUCCEEDED else 0), bad + (units if kind == FAILED_UNITS else 0)
    if status not in ENDED:
        if kind == FINISHED:
            status = "completed"
        elif kind == BROKEN:
            status, error = "failed", told
        elif kind in (STARTED, SUCCEEDED, FAILED_UNITS):
            status = "processing"
    return status, good, bad, error, version, first, last


class TaskStatus(StatefulProcessor):
    """One task's state; ``patience_ms`` of event time without an event fail it."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)
        self.seen = handle.getMapState("seen", "event_id string", "at long")  # entries are looked up one by one, so a task's events are never loaded together

    def _load(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else _FIRST

    def _changed(self, key: str, before: tuple, after: tuple) -> Iterator[pd.DataFrame]:
        new = before[5] is None or before[:4] != after[:4]
        after = (*after[:4], after[4] + int(new), *after[5:])
        self.state.update(after)
        if new:
            status, good, bad, error, version, first, last = after
            yield pd.DataFrame([(key, version, status, good, bad, good + bad, last - first, error)], columns=[x.split()[0] for x in CHANGES.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = after = self._load()
        events = sorted(((r.at.as_unit("ns").value // 1_000_000, r.event_id, r.kind, 0 if pd.isna(r.units) else int(r.units), None if pd.isna(r.error) else r.error) for batch in rows for r in batch.itertuples()), key=lambda e: e[:2])  # one batch of one task
        for ms, event_id, kind, units, error in events:
            if not self.seen.containsKey((event_id,)):
                self.seen.updateValue((event_id,), (ms,))
                after = applied(after, (ms, kind, units, error))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if after[0] not in ENDED:
            self.handle.registerTimer(after[6] + self.patience_ms)
        yield from self._changed(key[0], before, after)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._load()
        if before[0] not in ENDED:
            yield from self._changed(key[0], before, ("failed", *before[1:3], SILENT, *before[4:]))

    def close(self) -> None:
        pass


def statuses(events: DataFrame, patience: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """A stream of status changes (see ``CHANGES``) of a stream of events: event_id, task_id, kind, at, units, error. Needs the RocksDB state store."""
    with_workers(events.sparkSession)
    patience_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    rows = events.select(F.col("event_id").cast("string"), F.col("task_id").cast("string"), "kind", F.col("at").cast("timestamp"), F.col("units").cast("long"), F.col("error").cast("string"))
    watched = rows.where("task_id is not null and event_id is not null and at is not null").withWatermark("at", delay)
    return watched.groupBy("task_id").transformWithStateInPandas(TaskStatus(patience_ms), CHANGES, "Append", "eventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The current status of every task, of all changes so far."""
    fields = [c for c in changes.columns if c != "task_id"]
    return changes.groupBy("task_id").agg(F.max_by(F.struct(*fields), "version").alias("v")).select("task_id", "v.*")


class Progress(StreamingQueryListener):
    """Rows that a query has read and written, by query name."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[self._names.get(str(event.id), str(event.id))] = event.exception
