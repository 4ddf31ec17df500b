"""Usage counters as a stream: the same numbers as the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.tables import shared_dir

STATE = ["total", "purchases", "errors", "_last"]


def counters(events: DataFrame) -> DataFrame:
    """Counts for each user and the last event; two such tables can be added up."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.struct("ts", "event_id", "event_type")).alias("_last"))


def shown(state: DataFrame) -> DataFrame:
    return state.select("user_id", "total", "purchases", "errors", F.col("_last.event_id").alias("last_event_id"), F.col("_last.event_type").alias("last_event_type"))


def usage(events: DataFrame) -> DataFrame:
    """Running counters for each user: all, purchases, errors, and the last event."""
    return shown(counters(events))


def usage_from_stream(spark: SparkSession, sample: str, files: str, name: str = "usage") -> DataFrame:
    """Read files of events, named by a pattern, as a stream until none is left; return the final counters.
    sample: any of the files, for the schema.

    Each batch's counters are written to a folder of its number under the shared one, so a batch that is run again
    after a failure replaces its own; the stream's place is kept there too.  The counters of all batches add up to the
    result; no users pass through the driver.
    """
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        counters(batch).write.mode("overwrite").parquet(f"{base}/counts/batch={number}")

    source = spark.readStream.schema(spark.read.parquet(sample).schema).parquet(files)
    source.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/place").trigger(availableNow=True).start().awaitTermination()
    state = spark.read.parquet(f"{base}/counts")
    return shown(state.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in STATE[:3]], F.max("_last").alias("_last")))
