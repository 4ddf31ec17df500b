"""Exact deduplication by content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import hot_keys, materialise

#: Characters of the normalised text that the splitters compare; the whole text is compared when sorting.
SPLITTER_CHARS = 48


def normalised(text: str | Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), " \t\n\x0b\f\r", "")


def content_sort_dedup(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Find rows of equal normalised text, whatever their number.

    Rows are range-partitioned by sampled splitters over the head of the normalised text and a hash of all of it,
    so texts with a common head still spread, then sorted by the whole text within each range; equal texts stand
    next to each other and are compared in full.  Of a group the row with the longest original text stays, then
    the one with the smallest doc_id.  Copies of a hot text, one with a thousandth of all rows or more, also carry a
    salt: they are dealt over as many parts as thousandths, each part is sorted for itself, and the parts' bests, at
    most two thousand rows for all hot texts together, are then compared.

    Returns for every row: doc_id, keep_id, group_size, kept, text_sha256 and the columns named in carry.
    A null text counts as empty; rows with a null doc_id take part and are kept only where no row of the group
    has an id; of repeated rows with one doc_id exactly one is kept; an empty table gives an empty result.
    Columns of docs that are not carried are not read.
    """
    carry = carry or []
    rows = docs.select("doc_id", F.struct(*carry).alias("_carried") if carry else F.lit(None).cast("string").alias("_carried"), normalised("text").alias("_norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("_chars"))
    rows = rows.withColumn("_hash", F.xxhash64("_norm"))
    hot = hot_keys(rows.groupBy("_hash").count(), ["_hash"], "count", docs.count())
    if hot is None:
        rows = rows.withColumns({"_is_hot": F.lit(False), "_salt": F.lit(0)})
    else:
        # rows without a doc_id are dealt by where they stand in their input
        place = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(1))).otherwise(F.xxhash64(F.monotonically_increasing_id()))
        rows = rows.join(F.broadcast(hot), "_hash", "left").withColumns({"_is_hot": F.col("_parts").isNotNull(), "_salt": F.coalesce(F.pmod(place, F.col("_parts")), F.lit(0)).cast("int")}).drop("_parts")
    rows = rows.withColumn("_head", F.substring("_norm", 1, SPLITTER_CHARS))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "_head", "_hash", "_salt")
    group = Window.partitionBy("_head", "_hash", "_salt", "_norm")
    best = group.orderBy(F.col("_chars").desc(), F.col("doc_id").asc_nulls_last())
    rows = rows.select("*", F.row_number().over(best).alias("_rank"), F.first("doc_id").over(best).alias("_keep"), F.first("_chars").over(best).alias("_best_chars"), F.count(F.lit(1)).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_size"))
    sha = F.sha2(F.col("_norm").cast("binary"), 256)
    if hot is None:
        out = rows.select("doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_rank") == 1).alias("kept"), sha.alias("text_sha256"), "_carried")
    else:
        rows = materialise(rows.select("doc_id", "_carried", "_salt", "_rank", "_keep", "_best_chars", "_size", sha.alias("text_sha256"), F.when((F.col("_rank") == 1) & F.col("_is_hot"), F.col("_norm")).alias("_text")), "content-sort")
        order = F.struct((-F.col("_best_chars")).alias("c"), F.col("_keep").isNull().alias("n"), F.col("_keep").alias("id"), F.col("_salt").alias("s"))
        parts = rows.where(F.col("_text").isNotNull()).groupBy("_text").agg(F.first("text_sha256").alias("text_sha256"), F.min(order).alias("_b"), F.sum("_size").alias("_all"))
        parts = parts.select("text_sha256", F.col("_b.id").alias("_hot_keep"), F.col("_b.s").alias("_hot_salt"), "_all")
        rows = rows.join(F.broadcast(parts), "text_sha256", "left")  # a row for each hot text: bounded as hot is
        is_hot = F.col("_all").isNotNull()
        out = rows.select(
            "doc_id", F.when(is_hot, F.col("_hot_keep")).otherwise(F.col("_keep")).alias("keep_id"), F.when(is_hot, F.col("_all")).otherwise(F.col("_size")).alias("group_size"),
            ((F.col("_rank") == 1) & (~is_hot | (F.col("_hot_salt") == F.col("_salt")))).alias("kept"), "text_sha256", "_carried",
        )
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *[F.col("_carried")[c].alias(f"carried_{k}") for k, c in enumerate(carry)])


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that content_sort_dedup keeps, with all their columns.

    Whole rows travel through the sort, so nothing is joined back.  Edge cases are those of content_sort_dedup.
    """
    kept = content_sort_dedup(docs, carry=docs.columns).where("kept")
    return kept.select(*[F.col(f"carried_{k}").alias(c) for k, c in enumerate(docs.columns)])
