"""Machines by hand, the fold of a table against plain loops, and the stream against the fold over shuffled batches."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from factloom.operators import timers as T

SCHEMA = "key string, at long, event_id long, kind string, value double"


def results(spark, machine, rows):
    got = T.folded(spark.createDataFrame(rows, SCHEMA), machine).collect()
    return sorted(((r.key or "", r.at, r.what, r.n, r.number) for r in got), key=lambda r: r[:2])


def told(machine, events):
    """Results of one key's events, with all timers fired at the end."""
    state, out = machine.start, []
    for at, kind in events:
        state, fired = machine.until(state, at)
        state, more = machine.event(state, at, kind, None)
        out += fired + more
    return [r[:3] for r in out + machine.until(state, None)[1]]


def test_debounce_by_hand():
    m = T.Debounce(10, 4)
    assert told(m, [(0, None), (3, None), (9, None), (10, None)]) == [(4, "fired", 1), (14, "fired", 1)]
    assert told(T.Debounce(1, 4), [(0, None), (3, None), (6, None), (20, None)]) == [(10, "fired", 3), (24, "fired", 1)]
    assert told(T.Debounce(1, 4), [(0, None), (4, None)]) == [(4, "fired", 1), (8, "fired", 1)]  # due at the time of an event: before it
    assert told(m, []) == []


def test_in_flight_by_hand():
    m = T.InFlight(2, 5)
    assert told(m, [(0, "ask"), (1, "ask"), (1, "result"), (3, "ask"), (4, "result")]) == [(0, "started", 1), (1, "dropped", 1), (1, "done", 1), (3, "started", 2), (4, "done", 2)]
    # one waits, forced as one of two was; it starts when the first is done, although within the interval
    assert told(m, [(0, "ask"), (3, "ask"), (4, "force"), (4, "result"), (5, "result")]) == [(0, "started", 1), (3, "waits", 1), (4, "waits", 1), (4, "done", 1), (4, "started", 2), (5, "done", 2)]
    # given up after five; what waited stays till a later result
    assert told(m, [(0, "ask"), (3, "ask"), (6, "result"), (7, "ask"), (8, "result")]) == [(0, "started", 1), (3, "waits", 1), (5, "timeout", 1), (6, "ignored", 1), (7, "started", 2), (8, "done", 2), (8, "dropped", 2)]
    assert told(m, [(0, "force"), (1, "other")]) == [(0, "started", 1), (5, "timeout", 1)]


def test_guard_by_hand():
    m, of = T.MappingGuard(3), lambda *x: json.dumps(x)
    said = [w for _, w, _ in told(m, [
        (0, of("Game", "game", "", "")), (1, of("Game", "other", "", "")), (2, of("Game", "other", "", "")), (3, of("Game", "other", "", "")), (4, of("Game", "game", "", "")), (5, of("Game", "other", "", "")),
        (6, of("Game", "", "app", "")), (7, of("Game", "other", "game", "")), (8, of("Game", "", "", "meta")), (9, of("Game", "", "", "")), (10, of("", "x", "", "")), (11, None), (12, of("Game", "x", "game", "game")), (13, of("Else", "x", "", ""))])]
    assert said == ["trusted", "warning", "warning", "suspended: title", "trusted", "warning", "suspended: process", "warning", "suspended: metadata", "suspended: weak", "none", "none", "warning", "warning"]


def test_frames_against_a_plain_loop(spark):
    rnd = random.Random(4)
    rows, want = [], []
    for key in ("a", "b", None):
        times = sorted(rnd.randrange(20_000_000) for _ in range(300))
        rows += [(key, t, i, None, None) for i, t in enumerate(times)]
        start, worst, n, slow = times[0], 0.0, 0, 0
        for before, t in zip(times, times[1:]):
            gap = (t - before) / 1000
            n, worst, slow = n + 1, max(worst, gap), slow + (gap > 34)
            if t - start >= 1_000_000:
                want += [(key or "", t, "frames", n, worst), (key or "", t, "janky", slow, None)]
                start, worst, n, slow = t, 0.0, 0, 0
    rnd.shuffle(rows)
    got = results(spark, T.Frames(), [*rows, ("a", None, 1, None, None)])
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=lambda r: r[:2])] and [g[4] for g in got if g[2] == "frames"] == pytest.approx([w[4] for w in sorted(want, key=lambda r: r[:2]) if w[2] == "frames"])
    assert results(spark, T.Frames(), []) == []


@pytest.mark.parametrize("machine", [T.Debounce(3_000_000, 1_500_000), T.InFlight(2_000_000, 5_000_000), T.Frames(4_000_000)])
def test_stream_equals_fold(spark, tmp_path, machine):
    """Events dealt at random over micro-batches, some of them late."""
    rnd = random.Random(11)
    rows = [(rnd.choice("abc"), 10_000_000 + rnd.randrange(60) * 500_000, i, rnd.choice(["ask", "ask", "force", "result"]), 1.0) for i in range(90)]
    want = results(spark, machine, rows)
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    rnd.shuffle(rows)
    schema = "key string, ts timestamp, event_id long, kind string, value double"
    made = [(k, zero + timedelta(microseconds=at), i, kind, v) for k, at, i, kind, v in rows]
    end = zero + timedelta(days=3)
    for b, part in enumerate([made[:30], made[30:60], made[60:], [("end", end, 1000, "none", 0.0)], [("end", end, 1001, "none", 0.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{b}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in-*")
    out = T.streamed(stream, machine, "1 hour")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").where(F.col("key") != "end")
    assert sorted((r.key, r.at, r.what, r.n, r.number) for r in got.collect()) == sorted(want)
