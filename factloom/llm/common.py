"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sides up to this many rows of two or three numbers may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 500_000

#: A key with at least this share of a side's rows is hot: its rows are dealt over so many tasks that each gets about
#: this share.  There can be at most 1 / HOT_SHARE hot keys, so a list of them may be broadcast.
HOT_SHARE = 1 / 1000
#: No key of fewer rows is treated as hot.
LEAST_HOT = 200

#: Bytes of an Arrow batch, and entries that one Python worker remembers of words before it starts afresh.
ARROW_BYTES = 4 << 20
MAX_REMEMBERED = 150_000

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that the cluster names in spark.checkpoint.dir, or where that is unset
    in the warehouse, which executors and driver share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/factloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back, so that a lost executor
    costs no recomputation of what stands before."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete what materialise wrote for these; nothing that is still to be computed may depend on them."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that materialise wrote in this application, once its results are stored elsewhere."""
    _delete(spark, shared_dir(spark))


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame | None:
    """The keys of `counts` whose n is at least HOT_SHARE of total, with _parts to deal them over; None if none is."""
    least = max(LEAST_HOT, total * HOT_SHARE)
    hot = counts.where(F.col(n) >= least).select(*keys, F.ceil(F.col(n) / least).cast("int").alias("_parts"))
    rows = hot.collect()  # at most 1 / HOT_SHARE rows
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None, spread: str, how: str = "inner") -> DataFrame:
    """big joined with small (one row a key) on keys; rows of a hot key are dealt over its _parts by a hash of the
    column `spread`, and its row of small is repeated for each of them, so no task gets all rows of one key."""
    if hot is None:
        return big.join(small, keys, how)
    hot = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    left = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, group: list[str], order: list[str], what: str) -> tuple[DataFrame, int]:
    """df written with _pos, the place of a row within its group from 0, and _n, the group's number of rows; and the
    largest of these numbers.

    Rows are dealt by ranges of group, order and a salt and numbered within each range as they are sorted there; only
    a row for each group of each range is then added up, so a group of any size costs no task more than its range.
    Nulls come first; rows equal in all of `order` get some order among themselves."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *group, *order, "_salt").sortWithinPartitions(*group, *order, "_salt")
    rows = materialise(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()), what)
    part = F.shiftright("_at", 33)
    keys = [F.col(g).alias(f"_k{k}") for k, g in enumerate(group)]
    names = [f"_k{k}" for k in range(len(group))]
    runs = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    of_group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))  # at most a row a range here
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.select(*names, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_group).alias("_n")), f"{what}-runs")
    total, most = runs.agg(F.count(F.lit(1)), F.coalesce(F.max("_n"), F.lit(0))).first()
    same = F.col("_part") == part
    for name, g in zip(names, group):
        same &= F.col(name).eqNullSafe(F.col(g))
    out = rows.join(broadcast_if_small(runs, total), same).withColumn("_pos", F.col("_at") + F.col("_shift"))
    return out.drop("_at", "_part", "_shift", *names), most


def in_small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at a few megabytes instead of ten thousand rows: a worker holds one at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, key: str, bound: int, total: int | None = None, seed: int = 7) -> DataFrame:
    """About `bound` rows of df at most, chosen by a hash of the key: the same rows on every run, no row order
    needed and nothing sent through one task."""
    total = df.count() if total is None else total
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * bound / total))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side only when its counted rows stay under BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about max_bytes, one row at least, so that what a task holds as Python
    objects is bounded however long the texts are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
