"""Machines over the events of a key that also act when nothing comes: throttle and debounce, one request in flight,
windows that end by their frames, and a guard of mappings.  The same machine folds a table and runs as a stream.

Times are whole microseconds.  A machine has a start, `event` (state and event to state and results) and, where it sets
a timer, `due` (when) and `fire` (what then happens).  A timer that is due at the time of an event fires before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "at long, what string, n long, number double"
_EVENT = ["at", "event_id", "kind", "value"]


class Machine:
    """No timer; results are (at, what, n, number)."""

    start: tuple = ()

    def event(self, state: tuple, at: int, kind: str | None, value: float | None) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        return None

    def fire(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return state, []

    def until(self, state: tuple, at: int | None) -> tuple[tuple, list[tuple]]:
        """All timers that are due by `at`, or all there are."""
        out: list[tuple] = []
        while (due := self.due(state)) is not None and (at is None or due <= at):
            state, more = self.fire(state, due)
            out += more
        return state, out


class Debounce(Machine):
    """Events nearer than `throttle` to the last one heard are not heard; one that is starts a delay anew, and what
    comes of it comes when the delay has passed: (at, "fired", how many were heard, null)."""

    start = (None, None, 0)  # last heard, due, heard since the last firing

    def __init__(self, throttle: int = 1_000_000, delay: int = 400_000):
        self.throttle, self.delay = throttle, delay

    def event(self, state, at, kind, value):
        last, due, n = state
        if last is not None and at - last < self.throttle:
            return state, []
        return (at, at + self.delay, n + 1), []

    def due(self, state):
        return state[1]

    def fire(self, state, at):
        return (state[0], None, 0), [(at, "fired", state[2], None)]


class InFlight(Machine):
    """One request in flight and one waiting.  A request (`ask`, or `force`, which no interval holds back) within
    `interval` of the last start is dropped; while one is in flight it waits, forced if any was.  A `result` ends it and
    starts what waits; after `timeout` it is given up, and what waits stays till a later result.  Results:
    started, dropped, waits, done, ignored (a result of nothing) and timeout."""

    start = (None, None, False, False, 0)  # last start, timeout of what is in flight, waits, forced, requests started

    def __init__(self, interval: int = 2_000_000, timeout: int = 5_000_000):
        self.interval, self.timeout = interval, timeout

    def _ask(self, state, at, force):
        last, due, waits, forced, n = state
        if not force and last is not None and at - last < self.interval:
            return state, [(at, "dropped", n, None)]
        if due is not None:
            return (last, due, True, forced or force, n), [(at, "waits", n, None)]
        return (at, at + self.timeout, waits, forced, n + 1), [(at, "started", n + 1, None)]

    def event(self, state, at, kind, value):
        if kind in ("ask", "force"):
            return self._ask(state, at, kind == "force")
        if kind != "result":
            return state, []
        last, due, waits, forced, n = state
        if due is None:
            return state, [(at, "ignored", n, None)]
        out = [(at, "done", n, None)]
        if not waits:
            return (last, None, False, False, n), out
        state, more = self._ask((last, None, False, False, n), at, forced)
        return state, out + more

    def due(self, state):
        return state[1]

    def fire(self, state, at):
        last, _, waits, forced, n = state
        return (last, None, waits, forced, n), [(at, "timeout", n, None)]


class Frames(Machine):
    """Windows that end with the first frame at least `length` after their first: (end, "frames", frames, longest
    gap in milliseconds); frames later than `janky` milliseconds after the one before give (end, "janky", how many)."""

    start = (None, None, 0, 0.0, 0)  # first frame of the window, last frame, frames, longest gap, janky ones

    def __init__(self, length: int = 1_000_000, janky: float = 34.0):
        self.length, self.janky = length, janky

    def event(self, state, at, kind, value):
        first, last, n, worst, slow = state
        if first is None:
            return (at, at, 0, 0.0, 0), []
        gap = (at - last) / 1000
        n, worst, slow = n + 1, max(worst, gap), slow + (gap > self.janky)
        if at - first < self.length:
            return (first, at, n, worst, slow), []
        return (at, at, 0, 0.0, 0), [(at, "frames", n, worst), (at, "janky", slow, None)]


class MappingGuard(Machine):
    """Whether a mapping may be trusted: `kind` is a JSON list of mapping, title, process and metadata match.  Another
    process or other metadata suspend it at once, as does no match at all; another title warns, and suspends when it
    comes `limit` times in a row for one mapping; all else releases it."""

    start = (None, 0)

    def __init__(self, limit: int = 3):
        self.limit = limit

    def event(self, state, at, kind, value):
        mapping, title, process, metadata = ((str(x or "").strip().lower() for x in [*(json.loads(kind) if kind else []), None, None, None, None][:4]))
        if not mapping:
            return self.start, [(at, "none", 0, None)]
        if process and process != mapping:
            return self.start, [(at, "suspended: process", 0, None)]
        if metadata and metadata != mapping:
            return self.start, [(at, "suspended: metadata", 0, None)]
        if not (title or process or metadata):
            return self.start, [(at, "suspended: weak", 0, None)]
        if title and title != mapping:
            n = state[1] + 1 if state[0] == mapping else 1
            return (mapping, n), [(at, "suspended: title" if n >= self.limit else "warning", n, None)]
        return self.start, [(at, "trusted", 0, None)]


def folded(events: DataFrame, machine: Machine) -> DataFrame:
    """key, and RESULT of the machine over each key's events (key, at, event_id, kind, value) in order of time and
    event_id, with all its timers fired at the end.

    Rows stream through the fold with one state at hand: a key of any number of events needs constant memory.  Events
    without a time are left out; a null key is a key; equal times go by event_id."""
    kind = dict(events.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, none = None, None, object()
        key = none
        for pdf in batches:
            out = []
            for who, at, name, value in zip(pdf["key"], pdf["at"], pdf["kind"], pdf["value"], strict=True):
                who = None if pd.isna(who) else who
                if who != key:
                    if key is not none:
                        out += [(key, *r) for r in machine.until(state, None)[1]]
                    key, state = who, machine.start
                state, fired = machine.until(state, int(at))
                state, more = machine.event(state, int(at), None if pd.isna(name) else name, None if pd.isna(value) else value)
                out += [(key, *r) for r in fired + more]
            yield _table(out)
        if key is not none:
            yield _table([(key, *r) for r in machine.until(state, None)[1]])

    def _table(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["key", "at", "what", "n", "number"], dtype="object")
        return df.astype({"n": "Int64", "at": "Int64", "number": "float64"})

    rows = events.where("at IS NOT NULL").select("key", *_EVENT)
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, f"key {kind}, {RESULT}")


def streamed(events: DataFrame, machine: Machine, late: str = "1 hour") -> DataFrame:
    """The same for a stream of key, ts (timestamp), event_id, kind and value.

    Events of a key wait in its state until the watermark, `late` behind the newest time, has passed them, and are then
    taken in order; so results are those of `folded` however micro-batches are dealt, for events no later than that.
    Timers and waiting events set the timeout of the state in event time.  Later events are dropped by the watermark.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, waiting = (tuple(json.loads(state.get[0])), json.loads(state.get[1])) if state.exists else (machine.start, [])
        passed = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for pdf in parts:
                waiting += [[int(at), int(i), None if pd.isna(k) else k, None if pd.isna(v) else float(v)] for at, i, k, v in zip(pdf["at"], pdf["event_id"], pdf["kind"], pdf["value"], strict=True)]
            waiting.sort(key=lambda e: (e[0], e[1]))
        out, done = [], 0
        for at, _, kind, value in waiting:
            if at > passed:
                break
            now, fired = machine.until(now, at)
            now, more = machine.event(now, at, kind, value)
            out, done = out + fired + more, done + 1
        waiting = waiting[done:]
        now, fired = machine.until(now, passed)
        out += fired
        state.update((json.dumps(now), json.dumps(waiting)))
        after = min([t for t in (machine.due(now), waiting[0][0] if waiting else None) if t is not None], default=None)
        if after is not None:
            state.setTimeoutTimestamp(max(after // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        df = pd.DataFrame([(key[0], *r) for r in out], columns=["key", "at", "what", "n", "number"], dtype="object")
        yield df.astype({"n": "Int64", "at": "Int64", "number": "float64"})

    kind = dict(events.dtypes)["key"]
    rows = events.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("at"), "event_id", "kind", "value")
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, {RESULT}", "now string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
