"""Recent messages of each session as stream state, and refreshed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "seq long, created_at timestamp, content string"
OUTPUT = "session_id string, seq long, created_at timestamp, content string, n long"
LISTS = "session_id string, seq array<long>, at array<long>, content array<string>"
HELD = "seq array<long>, at array<long>, content array<string>, stored_seq array<long>, stored_at array<long>, stored_content array<string>, last long"


class RecentMessages(StatefulProcessor):
    """Keeps the newest `size` messages of a session, for `ttl_ms` after the last of them; sends the list on every change."""

    def __init__(self, size: int = 50, ttl_ms: int | None = 86_400_000):
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", STATE, self.ttl_ms) if self.ttl_ms else handle.getListState("recent", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(r.seq), r.created_at.to_pydatetime(), r.content) for frame in rows for r in frame.itertuples()]
        held = [(int(s), t, c) for s, t, c in self.recent.get()] if self.recent.exists() else []
        held = sorted(held + fresh, key=lambda r: (r[1], r[0]))[-self.size :]
        self.recent.put(held)  # renews the time to live
        yield pd.DataFrame({"session_id": key[0], "seq": [r[0] for r in held], "created_at": [r[1] for r in held], "content": [r[2] for r in held], "n": len(held)})

    def close(self) -> None:
        pass


def hot_context(stream: DataFrame, size: int = 50, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """stream (session_id, seq, created_at, content) to the recent messages of the sessions that changed.

    Needs the RocksDB state store.  With a time to live, set
    spark.sql.streaming.noDataMicroBatches.enabled to false for runs that end.
    """
    return stream.groupBy("session_id").transformWithStateInPandas(RecentMessages(size, ttl_ms), OUTPUT, "Update", "ProcessingTime" if ttl_ms else "None")


class LiveContext(StatefulProcessor):
    """Recent messages by event time: after `ttl` without a message a session's list is gone, and it starts again from its stored history.

    Stored history is the session's oldest `limit` messages; those of before
    the stream come as initial state.  A session that has none yet begins with
    it too.
    """

    def __init__(self, size: int = 50, ttl_ms: int = 86_400_000, limit: int = 20):
        self.size, self.ttl_ms, self.limit = size, ttl_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent, self.stored = handle.getListState("recent", STATE), handle.getListState("stored", STATE)
        self.last = handle.getValueState("last", "at long")

    def _first(self, rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda r: (r[1], r[0]))[: self.limit]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        old = [(int(s), t, c) for s, t, c in self.stored.get()]
        self.stored.put(self._first(old + [(int(r.seq), r.created_at.to_pydatetime(), r.content) for r in initialState.itertuples()]))

    def _after(self, held: list[tuple], stored: list[tuple], last: int | None, fresh: list[tuple]) -> tuple[list[tuple], list[tuple], int]:
        """The list, the stored history and the time of the last message after `fresh` ones (seq, time, content, milliseconds), in order."""
        for *row, at in fresh:
            if last is None or at - last >= self.ttl_ms:
                held = list(stored)
            held = [*held, tuple(row)][-self.size :]
            stored = self._first([*stored, tuple(row)]) if len(stored) < self.limit else stored
            last = at if last is None else max(last, at)
        return held, stored, last

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, stored = ([(int(s), t, c) for s, t, c in state.get()] for state in (self.recent, self.stored))
        known, before = len(stored), self.last.get()
        before = before[0] if before else None
        fresh = sorted(((int(r.seq), r.created_at.to_pydatetime(), r.content, int(r.created_at.value // 1_000_000)) for frame in rows for r in frame.itertuples()), key=lambda r: (r[1], r[0]))
        held, stored, last = self._after(held, stored, before, fresh)
        if before is not None:  # each call of a state is a message to the JVM and back
            self.handle.deleteTimer(before + self.ttl_ms)  # if it has fired there is none
        self.handle.registerTimer(last + self.ttl_ms)
        self.last.update((last,))
        self.recent.put(held)
        if len(stored) != known:
            self.stored.put(stored)
        yield pd.DataFrame({"session_id": key[0], "seq": [r[0] for r in held], "created_at": [r[1] for r in held], "content": [r[2] for r in held], "n": len(held)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield pd.DataFrame({"session_id": [key[0]], "seq": pd.array([None], "Int64"), "created_at": [pd.NaT], "content": [None], "n": [0]})

    def close(self) -> None:
        pass


def _columns(rows: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]


class LiveRows(LiveContext):
    """The same in one state a session, read and written once a batch, with a row a session for what comes in as stored history and for what goes out.

    A session costs a few messages to the JVM and no pandas frame, as there may
    be a great many of them in a batch.  Times are microseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def _get(self) -> tuple[list[tuple], list[tuple], int | None]:
        held = self.held.get()
        if not held:
            return [], [], None
        return list(zip(*held[:3], strict=True)), list(zip(*held[3:6], strict=True)), held[6]

    def _put(self, recent: list[tuple], stored: list[tuple], last: int | None) -> None:
        self.held.update((*_columns(recent), *_columns(stored), last))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._put([], self._first([(r["seq"], r["at"], r["content"]) for r in initialState.stored]), None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, stored, before = self._get()
        fresh = sorted(((r.seq, r.at, r.content, r.at // 1000) for r in rows), key=lambda r: (r[1], r[0]))
        held, stored, last = self._after(held, stored, before, fresh)
        if before is not None and before != last:
            self.handle.deleteTimer(before + self.ttl_ms)  # if it has fired there is none
        self.handle.registerTimer(last + self.ttl_ms)
        self._put(held, stored, last)
        seq, at, content = _columns(held)
        yield Row(session_id=key[0], seq=seq, at=at, content=content)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, stored, last = self._get()
        self._put([], stored, last)
        yield Row(session_id=key[0], seq=[], at=[], content=[])


def live_context(stream: DataFrame, stored: DataFrame | None = None, size: int = 50, ttl_ms: int = 86_400_000, limit: int = 20) -> DataFrame:
    """stream (session_id, seq, created_at, content), with a watermark on created_at, to the recent messages of the sessions that changed.

    A session whose last message is `ttl_ms` or more before the watermark sends
    one row with n = 0.  stored: messages of before, in the same columns, whose
    oldest `limit` by session are given along as initial state.
    """
    at = F.unix_micros("created_at").alias("at")
    if stored is not None:
        first = Window.partitionBy("session_id").orderBy("created_at", "seq")
        kept = stored.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= limit)
        stored = kept.groupBy("session_id").agg(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), at, "content")).alias("stored")).groupBy("session_id")
    rows = stream.select("session_id", F.col("seq").cast("long").alias("seq"), "created_at", at, "content")
    lists = rows.groupBy("session_id").transformWithState(LiveRows(size, ttl_ms, limit), LISTS, "Update", "EventTime", stored)
    found = lists.select("session_id", F.size("seq").cast("long").alias("n"), F.explode_outer(F.arrays_zip("seq", "at", "content")).alias("r"))
    return found.select("session_id", "r.seq", F.timestamp_micros("r.at").alias("created_at"), "r.content", "n")


class LatestTable:
    """A view that every refresh replaces, unless it fails or brings no rows: then the last good one stays."""

    def __init__(self, view: str, load: Callable[[], DataFrame]):
        self.view, self.load, self.errors = view, load, 0

    def refresh(self, *_: object) -> None:
        """Also a function for foreachBatch, so that a trigger's processing time is the refresh interval."""
        try:
            rows = self.load()
            if not rows.isEmpty():
                rows.createOrReplaceTempView(self.view)
        except Exception:  # any failure of the source keeps the old view
            self.errors += 1
