"""Queries over clusters of facts with vectors; checked against a plain loop in the tests, as first fit has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import canonical as C
from factloom.plans.mechanic_queries import records
from factloom.sources.tables import table, written


def items(spark, sf_dir) -> DataFrame:
    """The record of every fact of every document with the vector of its document; facts of a document without one stand
    alone.  item_id: the number of the document times 2^31 and the fact's position, which is the order of facts."""
    at = F.col("doc_id").cast("bigint") * F.lit(1 << 31) + F.col("pos")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    r = records(spark, sf_dir).withColumn("item_id", at).join(v, "doc_id", "left")
    return r.select("label", "item_id", "embedding", *C.LISTS, *C.FLAGS, "active_signals", "representation", "novelty", "obviousness", "inter", "final_priority", "role_tags")


def canonical_facts(spark, sf_dir):
    """Facts that stand for the clusters of their label."""
    of = written(items(spark, sf_dir), "items")
    return C.canonical_facts(of, C.gated_clusters(of, "label"), "label")


def canonical_diagnostics(spark, sf_dir):
    """What the clustering of each label merged and what it refused."""
    return C.cluster_diagnostics(C.gated_clusters(written(items(spark, sf_dir), "items"), "label"), "label")


QUERIES = {f.__name__: f for f in (canonical_facts, canonical_diagnostics)}
SQL: dict[str, str] = {}
