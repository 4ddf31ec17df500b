"""Queries over sections and chunks of pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import sections as Z
from factloom.sources import tables as S
from factloom.sources.tables import dealt, table

#: Sections of a page that are kept apart.
MOST_SECTIONS = 60


def section_tree(spark, sf_dir):
    """Sections of page texts with their paths: tiny ones of one path together, no more than MOST_SECTIONS a page."""
    p = dealt(table(spark, sf_dir, "pages")).select("page_id", S.article_body("html").alias("body")).select("page_id", S.markup_text("body").alias("text"))
    p = Z.with_sections(p, "text").withColumn("sections", Z.with_paths(F.col("sections"))).withColumn("sections", Z.merge_same_path(F.col("sections")))
    p = p.withColumn("sections", Z.merge_to_budget(F.col("sections"), MOST_SECTIONS)).select("page_id", F.posexplode_outer("sections").alias("pos", "s")).where("pos IS NOT NULL")  # a plain explode makes Spark infer a filter that spells out every fold again
    return p.select("page_id", F.concat(F.lit("sec-"), (F.col("pos") + 1).cast("string")).alias("section_id"), "s.path", "s.parent", F.col("s.depth").cast("bigint").alias("depth"), F.col("s.tokens").alias("tokens"), "s.heading")


def chunk_texts(spark, sf_dir):
    """Documents in chunks of at most 1500 tokens, with their texts."""
    d = Z.with_sections(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")
    d = d.select("doc_id", F.posexplode_outer(Z.chunk_texts(F.col("text"), F.col("sections"))).alias("pos", "text")).where("pos IS NOT NULL")
    return d.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("chunk_id"), X.estimate_tokens("text").alias("tokens"), "text")


QUERIES = {f.__name__: f for f in (section_tree, chunk_texts)}
SQL: dict[str, str] = {}
