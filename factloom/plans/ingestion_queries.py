"""Queries that run whole chains: pages to facts by section, packages, and batches of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import ingestion as I
from factloom.plans.mechanic_queries import _RECORD, PROSE, records
from factloom.sources import packages
from factloom.sources import tables as S
from factloom.sources.tables import dealt, shared_dir, table


def _pages(spark, sf_dir):
    p = dealt(table(spark, sf_dir, "pages")).select("page_id", S.article_body("html").alias("body"))
    return p.select("page_id", S.markup_text("body").alias("text"))


def page_section_density(spark, sf_dir):
    """Facts of each section of the pages, and how dense they stand."""
    return I.ingest(_pages(spark, sf_dir), PROSE)["density"]


def section_facts(spark, sf_dir):
    """The facts of all pages, each with the section that has it first."""
    return I.ingest(_pages(spark, sf_dir), PROSE)["facts"]


def section_package(spark, sf_dir):
    """Sections, facts and density committed as one package and read back: rows of each part."""
    path = f"{shared_dir(spark)}/package"
    packages.commit_package(I.ingest(_pages(spark, sf_dir), PROSE), path)
    parts = packages.read_package(spark, path)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in sorted(parts.items())]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def _jobs(spark, sf_dir):
    """A job for each document by its language, and jobs for documents that there are not."""
    docs, gone = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select(F.col("doc_id").alias("job_id"), F.col("lang").alias("tier"), "doc_id").unionByName(gone.select((F.col("doc_id") + 1_000_000_000).alias("job_id"), F.lit("gone").alias("tier"), (F.col("doc_id") + 1_000_000_000).alias("doc_id")))


def _ran(spark, sf_dir):
    return I.run_jobs(_jobs(spark, sf_dir), table(spark, sf_dir, "documents"), records(spark, sf_dir).select("doc_id", "fact", "drop_reason", "layer"), cap=20_000)


def batch_jobs(spark, sf_dir):
    """Every job with its status, and where and why it failed."""
    return _ran(spark, sf_dir)


def batch_report(spark, sf_dir):
    """Jobs by tier, status, stage and code."""
    return I.run_report(_ran(spark, sf_dir))


QUERIES = {f.__name__: f for f in (page_section_density, section_facts, section_package, batch_jobs, batch_report)}

_RAN = _RECORD + """, j AS (SELECT doc_id AS job_id, lang AS tier, doc_id FROM documents UNION ALL SELECT doc_id + 1000000000, 'gone', doc_id + 1000000000 FROM labels),
  n AS (SELECT doc_id, count_if(coalesce(fact, '') <> '') AS candidates, count_if(drop_reason IS NULL) AS kept, count_if(drop_reason IS NULL AND layer = 'A') AS deep FROM record GROUP BY 1),
  c AS (SELECT job_id, tier, coalesce(candidates, 0) AS candidates, coalesce(kept, 0) AS kept, coalesce(deep, 0) AS deep, CASE WHEN tier IS NULL OR j.doc_id IS NULL THEN 'bad-job' WHEN d.text IS NULL THEN 'missing-source' WHEN strlen(d.text) > 20000 THEN 'source-too-large'
        WHEN coalesce(candidates, 0) = 0 THEN 'no-candidates' WHEN coalesce(kept, 0) = 0 THEN 'no-facts' END AS code FROM j LEFT JOIN documents d ON d.doc_id = j.doc_id LEFT JOIN n ON n.doc_id = j.doc_id),
  ran AS (SELECT job_id, tier, CASE WHEN code IS NULL THEN 'success' ELSE 'failed' END AS status, CASE code WHEN 'bad-job' THEN 'read' WHEN 'missing-source' THEN 'fetch' WHEN 'source-too-large' THEN 'fetch' WHEN 'no-candidates' THEN 'extract' WHEN 'no-facts' THEN 'normalize' END AS stage, code,
        CASE WHEN code IS NULL THEN candidates ELSE 0 END AS candidates, CASE WHEN code IS NULL THEN kept ELSE 0 END AS kept, CASE WHEN code IS NULL THEN deep ELSE 0 END AS deep FROM c) """
SQL = {
    "batch_jobs": _RAN + "SELECT * FROM ran",
    "batch_report": _RAN + "SELECT tier, status, stage, code, count(*) AS jobs, sum(candidates)::BIGINT AS candidates, sum(kept)::BIGINT AS kept, sum(deep)::BIGINT AS deep FROM ran GROUP BY 1, 2, 3, 4",
}
