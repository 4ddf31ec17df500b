"""Documents to token ids in five stages; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, content_sort, mixing, near_dup, quality
from factloom.llm.common import discard, materialise, table
from factloom.llm.queries import MIX_WEIGHTS, tokenizer

#: Documents whose calibrated score is below this are rejected: only what is likelier junk than not by far.
REJECT_BELOW = 0.35


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier does not reject."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, "_quality").where(F.col("_quality") >= REJECT_BELOW).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return content_sort.distinct_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates of similarity 0.8 or more."""
    return near_dup.without_near_duplicates(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokens follow the target weights, one epoch, nine tenths of what there is."""
    return mixing.mix(docs, MIX_WEIGHTS, fraction=0.9, max_epochs=1).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and what they decode to, as digests."""
    return byte_bpe.encode_digests(docs, *tokenizer())


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage), ("mixing to target weights", mixing_stage), ("byte-level BPE", encoding_stage)]

#: The classifier cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents.

    A stage's rows are deleted once the next one's are written, so at most two stages lie on disk beside what the
    operators keep; the last stage's stay, as they are the result.  Nulls, repeated rows and empty tables are handled
    as the operators of the stages say.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{k}")
        discard(before)
    return docs
