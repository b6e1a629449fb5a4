"""Backfill cursors as keyed state with timers: per community where a backfill stands, how old it has got, and whether it has stalled."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUT = "community string, cursor string, cursor_created timestamp, floor timestamp, status string, told timestamp"
_STATE = "cursor string, created timestamp, floor timestamp, capped boolean, told timestamp"


def _cursor(idle: timedelta) -> StatefulProcessor:
    """Defined in here, so that it is sent as a whole: the runner of a stream's state doesn't get the session's files."""

    class Cursor(StatefulProcessor):
        def __init__(self, idle: timedelta) -> None:
            self.idle_ms = int(idle.total_seconds() * 1000)

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("cursor", _STATE)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            cursor, created, floor, capped, newest = self.state.get() if self.state.exists() else (None, None, None, False, None)
            for some in rows:
                told = some.dropna(subset=["cursor", "created"], how="all").sort_values(["seen", "created", "cursor"], ascending=[True, False, True], na_position="first")
                if len(told):  # the last that was told, as it is, as the store keeps it
                    last = told.iloc[-1]
                    if newest is None or last["seen"] >= pd.Timestamp(newest):
                        newest, cursor, created = last["seen"], last["cursor"], (None if pd.isna(last["created"]) else last["created"])
                oldest = some["created"].min()
                if not pd.isna(oldest) and (floor is None or oldest < floor):  # only ever older
                    floor = oldest
                capped = bool(capped or some["capped"].fillna(False).any())
                until = int(some["seen"].max().timestamp() * 1000) + self.idle_ms
                timers = list(self.handle.listTimers())
                if not timers or max(timers) < until:
                    for old in timers:
                        self.handle.deleteTimer(old)
                    self.handle.registerTimer(until)
            as_time = lambda t: None if t is None or pd.isna(t) else pd.Timestamp(t).to_pydatetime()
            self.state.update((cursor, as_time(created), as_time(floor), capped, as_time(newest)))
            yield self._row(key, cursor, created, floor, "DONE_CAPPED" if capped else "RUNNING", newest)

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.state.exists():
                cursor, created, floor, capped, told = self.state.get()
                yield self._row(key, cursor, created, floor, "DONE_CAPPED" if capped else "STALLED", told)

        def _row(self, key, cursor, created, floor, status, told) -> pd.DataFrame:
            frame = pd.DataFrame({"community": [key[0]], "cursor": [cursor], "cursor_created": [created], "floor": [floor], "status": [status], "told": [told]})
            return frame.astype({"cursor_created": "datetime64[ns]", "floor": "datetime64[ns]", "told": "datetime64[ns]"})

        def close(self) -> None:
            pass

    return Cursor(idle)


def cursors(pages: DataFrame, idle: timedelta = timedelta(days=1), late: str = "1 hour") -> DataFrame:
    """A stream of ``pages`` (community, seen, cursor, created, capped): a row for each community of a batch, and one when it stalls.

    ``cursor`` and ``cursor_created`` are the last told by time of arrival, ``seen``, which is ``told`` (of equal times the oldest, then the last by name);
    pages without both don't move them. ``floor`` is the oldest time of creation, which repeated pages and newer ones never raise. A
    community without pages for ``idle`` of event time is STALLED, one with a capped page DONE_CAPPED, others RUNNING. Pages that
    arrive behind the watermark are left out. State outlives restarts by the stream's checkpoint; a community is one key.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return pages.withWatermark("seen", late).groupBy("community").transformWithStateInPandas(_cursor(idle), OUT, "Update", "EventTime")
