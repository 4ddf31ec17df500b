"""Queries that fold the events of each user through a machine with timers; checked by hand, against plain loops and as
streams in the tests.

The machines' defaults are seconds, as an application needs them; users of the tables do something every few hours, so
the queries give lengths that suit such events."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import timers as T
from factloom.sources.tables import table

HOUR = 3_600_000_000


def _events(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", kind.alias("kind"), "value")


def focus_requests(spark, sf_dir):
    """What comes of each user's events when those within an hour are not heard and a delay of half an hour starts anew."""
    return T.folded(_events(spark, sf_dir, F.lit(None).cast("string")), T.Debounce(HOUR, HOUR // 2)).withColumnRenamed("key", "user_id")


def requests_in_flight(spark, sf_dir):
    """Clicks ask, purchases force, views answer: what becomes of each, with one request in flight and one waiting."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 'ask' WHEN 'purchase' THEN 'force' WHEN 'view' THEN 'result' END")
    return T.folded(_events(spark, sf_dir, kind), T.InFlight(2 * HOUR, 5 * HOUR)).withColumnRenamed("key", "user_id")


def frame_runs(spark, sf_dir):
    """Windows of each user's events that end with the first one a day or more after their first."""
    return T.folded(_events(spark, sf_dir, F.lit(None).cast("string")), T.Frames(24 * HOUR, 3_600_000.0)).withColumnRenamed("key", "user_id")


def guarded_mappings(spark, sf_dir):
    """Whether a user's mapping, the type of their first event, is trusted after each event: the type is the title; the
    property tells process and metadata of some events."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy(F.col("user_id").alias("who")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("mapping"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.to_json(F.array("mapping", F.when(k % 3 != 0, F.col("event_type")).otherwise(""), F.when(k % 7 == 0, F.col("event_type")).otherwise(""), F.when(k % 11 == 0, F.col("event_type")).otherwise("")))
    rows = e.join(first, F.col("user_id").eqNullSafe(F.col("who"))).select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", kind.alias("kind"), "value")
    return T.folded(rows, T.MappingGuard(3)).withColumnRenamed("key", "user_id")


QUERIES = {f.__name__: f for f in (focus_requests, requests_in_flight, frame_runs, guarded_mappings)}
SQL: dict[str, str] = {}
