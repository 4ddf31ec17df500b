"""Sections of pages to facts: chunks of each section, rules, repeats within a section and then across, density; and
batches of jobs that fail one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import mechanics as M
from factloom.operators import sections as Z
from factloom.sources.tables import written

MOST_SECTIONS, MOST_CHUNK = 60, 1500
SOURCE_BYTES = 2 << 20
PLACE = ["page_id", "section", "chunk", "pos"]


def sections_of(pages: DataFrame, most: int = MOST_SECTIONS) -> DataFrame:
    """page_id, section (from 1), path, heading, tokens and text; of pages (page_id, text)."""
    p = Z.with_sections(pages.select("page_id", "text"), "text").withColumn("sections", Z.merge_to_budget(Z.merge_same_path(Z.with_paths(F.col("sections"))), most))
    p = p.select("page_id", F.posexplode_outer("sections").alias("at", "s")).where("at IS NOT NULL")
    return p.select("page_id", (F.col("at") + 1).alias("section"), "s.path", "s.heading", "s.tokens", "s.text")


def candidates(sections: DataFrame, most: int = MOST_CHUNK) -> DataFrame:
    """Sentences of the chunks of each section in order: PLACE, fact, and what stands around it."""
    chunks = sections.select("page_id", "section", F.posexplode_outer(Z.split_large(F.col("text"), most)).alias("chunk", "text")).where("chunk IS NOT NULL")
    parts = chunks.select("page_id", "section", "chunk", F.split("text", "[.!?]+\\s+").alias("p"))
    around = F.transform("p", lambda x, i: F.struct(x.alias("raw"), F.concat_ws(" ", F.right(F.get("p", i - 1), F.lit(140)), x, F.left(F.get("p", i + 1), F.lit(140))).alias("context")))
    rows = parts.select("page_id", "section", "chunk", F.posexplode_outer(around).alias("pos", "x")).where("pos IS NOT NULL")
    return rows.select(*PLACE, X.collapse("x.raw").alias("fact"), "x.context").withColumn("source", F.lit("page"))


def ingest(pages: DataFrame, policy: M.Policy | None = None, most_sections: int = MOST_SECTIONS, most_chunk: int = MOST_CHUNK) -> dict[str, DataFrame]:
    """Pages (page_id, text) to `sections`, `facts` and `density`, in one call.

    Each section is cut into chunks and each chunk into sentences; those that pass the rules are facts.  Of equal ones
    the first within a section stays, of these the first of all, in order of page, section, chunk and place.  facts has
    a row for each text that stays, with the number of sections that have it; density has one for each section:
    candidates, those that passed, those that are new within it, those that are first there, and these for each
    thousand tokens.  Only minima and counts by text and section are shuffled, formed in each task first, so neither a
    frequent text nor a long page costs a task more than its share.  Pages without text have no sections; a section
    without facts has density 0; no pages give no rows.
    """
    sections = written(sections_of(pages, most_sections), "sections")
    found = M.with_record(candidates(sections, most_chunk), policy=policy).select(*PLACE, "fact", "drop_reason", "layer", F.lower("fact").alias("key"))
    found = written(found, "candidates")
    in_section = found.where("drop_reason IS NULL").groupBy("page_id", "section", "key").agg(F.min(F.struct("chunk", "pos", "fact", "layer")).alias("at"), F.count(F.lit(1)).alias("n"))
    in_section = written(in_section, "in-section")
    facts = in_section.groupBy("key").agg(F.min(F.struct("page_id", "section", "at")).alias("f"), F.count(F.lit(1)).alias("n_sections"), F.sum("n").alias("n"))
    facts = written(facts.select("f.page_id", "f.section", "f.at.chunk", "f.at.pos", "f.at.fact", "f.at.layer", "n_sections", "n"), "facts")
    seen = found.groupBy("page_id", "section").agg(F.count(F.lit(1)).alias("candidates"))
    own = in_section.groupBy("page_id", "section").agg(F.sum("n").alias("passed"), F.count(F.lit(1)).alias("within"))
    first = facts.groupBy("page_id", "section").agg(F.count(F.lit(1)).alias("first"), F.count_if(F.col("layer") == "A").alias("deep"))
    density = sections.select("page_id", "section", "path", "tokens")
    for part in (seen, own, first):
        density = density.join(part, ["page_id", "section"], "left")
    density = density.select("page_id", "section", "path", "tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "passed", "within", "first", "deep")])
    per_thousand = F.when(F.col("tokens") > 0, F.round(F.col("first") * 1000 / F.col("tokens"), 3)).otherwise(0.0)
    return {"sections": sections.drop("text"), "facts": facts, "density": density.withColumn("per_thousand_tokens", per_thousand)}


def run_jobs(jobs: DataFrame, sources: DataFrame, facts: DataFrame, done: DataFrame | None = None, cap: int = SOURCE_BYTES) -> DataFrame:
    """A row for each job (job_id, tier, doc_id) that `done` does not have as a success: its status, the stage and code
    at which it failed, and its facts.  One job's failure is its own row; all others go on.

    sources: doc_id and text, one row each; facts: doc_id, drop_reason and layer.  Codes: bad-job (no tier or
    document), missing-source, source-too-large, no-candidates, no-facts.  A job that comes twice has two rows.
    """
    if done is not None:
        jobs = jobs.join(done.where("status = 'success'").select("job_id").distinct(), "job_id", "left_anti")
    size = sources.select("doc_id", F.octet_length("text").alias("_bytes"))
    counts = facts.groupBy("doc_id").agg(F.count_if(F.coalesce("fact", F.lit("")) != "").alias("candidates"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if(F.col("drop_reason").isNull() & (F.col("layer") == "A")).alias("deep"))
    rows = jobs.join(size, "doc_id", "left").join(counts, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    code = F.when(F.col("tier").isNull() | F.col("doc_id").isNull(), "bad-job").when(F.col("_bytes").isNull(), "missing-source").when(F.col("_bytes") > cap, "source-too-large").when(n("candidates") == 0, "no-candidates").when(n("kept") == 0, "no-facts")
    rows = rows.withColumn("code", code)
    stage = F.when(F.col("code") == "bad-job", "read").when(F.col("code").isin("missing-source", "source-too-large"), "fetch").when(F.col("code") == "no-candidates", "extract").when(F.col("code") == "no-facts", "normalize")
    ok = F.col("code").isNull()
    return rows.select("job_id", "tier", F.when(ok, "success").otherwise("failed").alias("status"), stage.alias("stage"), "code", *[F.when(ok, n(c)).otherwise(0).alias(c) for c in ("candidates", "kept", "deep")])


def run_report(results: DataFrame, by: str | Column = "tier") -> DataFrame:
    """Jobs by tier, status, stage and code, with their facts."""
    return results.groupBy(by, "status", "stage", "code").agg(F.count(F.lit(1)).alias("jobs"), *[F.sum(c).alias(c) for c in ("candidates", "kept", "deep")])
