"""Ordered state over events: sticky context with confirmation, for batches and streams; lists of the newest events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How many events each list keeps.
KEPT = 1000
STICKY_S, COOLDOWN_S, CONFIRMATIONS = 30.0, 3.0, 2
START = (None, 0.0, None, 0, 0.0)  # current, when it was seen, proposed, how often, when it last changed


def step(state: tuple, name: str | None, at: float) -> tuple:
    """The next state: a missing name leaves the current one for STICKY_S; another name takes over after so many
    confirmations in a row, COOLDOWN_S after the last change at the earliest."""
    current, seen, proposed, times, changed = state
    if name is None:
        return (None, seen, None, 0, at) if current is not None and at - seen > STICKY_S else (current, seen, None, 0, changed)
    if name == current:
        return (current, at, None, 0, changed)
    if current is None:
        return (name, at, None, 0, at)
    times = times + 1 if proposed == name else 1
    if times >= CONFIRMATIONS and at - changed >= COOLDOWN_S:
        return (name, at, None, 0, at)
    return (current, seen, name, times, changed)


def context_states(events: DataFrame) -> DataFrame:
    """user_id, event_id, context after each event; events of a user are folded in order of (ts, event_id).

    Sorted rows stream through the fold with one state at hand, so a task's memory does not grow with a user's
    events.  A null user is a user; an event without a time comes first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = START, START  # no user is called START
        for pdf in batches:
            out = []
            for who, name, at in zip(pdf["user_id"], pdf["name"], pdf["at"], strict=True):
                who = None if pd.isna(who) else who
                if who != user:
                    user, state = who, START
                state = step(state, None if pd.isna(name) else name, 0.0 if pd.isna(at) else at)
                out.append(state[0])
            yield pd.DataFrame({"user_id": pdf["user_id"].astype("Int64"), "event_id": pdf["event_id"], "context": pd.Series(out, index=pdf.index, dtype="object")})

    rows = events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "name")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, "user_id long, event_id long, context string")


def newest_by_list(events: DataFrame, name: str | Column, order: list[str], lists: dict[str, str], kept: int = KEPT) -> DataFrame:
    """Events with the list that their name goes to and their place in it, the newest first, `kept` of each list.

    Names are trimmed; events of no name, or of one without a list, go nowhere.  `order` are the columns that tell the age;
    rows alike in all of them stand in any order.  The limit is applied in every task before events of a list are brought
    together, so one list may get all events.
    """
    to = F.element_at(F.create_map(*[F.lit(x) for pair in lists.items() for x in pair]), F.trim(F.col(name) if isinstance(name, str) else name))
    w = Window.partitionBy("list").orderBy(*[F.col(c).desc() for c in order])
    routed = events.withColumn("list", to).where(F.col("list").isNotNull())
    return routed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= kept)


def context_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: state is kept for every user between batches."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        now = tuple(state.get) if state.exists else START
        out = []
        for name, at in zip(pdf["name"], pdf["ts"].astype("int64") / 1e9, strict=True):
            now = step(now, None if pd.isna(name) else name, at)
            out.append(now[0])
        state.update(now)
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "context": pd.Series(out, index=pdf.index, dtype="object")})

    return events.select("user_id", "event_id", "ts", "name").groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, context string", "current string, seen double, proposed string, times int, changed double", "append", GroupStateTimeout.NoTimeout)
