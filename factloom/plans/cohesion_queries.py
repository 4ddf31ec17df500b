"""Queries over the cohesion of chunks, quoted names and intents; with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import cohesion as C
from factloom.plans.mechanic_queries import _RECORD, records
from factloom.sources.tables import facts, table, written

#: Intents by priority with their patterns in order; a parameter, for the prose of the tables.
RULES = [("greeting", 1, ["hello", "thanks"]), ("howto", 2, ["how to", "explain", "in der"]), ("fact", 3, ["what is", "which", "de la", "was"]), ("prose", 4, ["of the", "und", "que", "and"])]


def _chunks(spark, sf_dir):
    return C.chunk_cohesion(written(records(spark, sf_dir).where("drop_reason IS NULL").select("doc_id", "families", "systems", "keywords"), "cohesion"))


def chunk_drift(spark, sf_dir):
    """How well the kept facts of a document hold together."""
    return _chunks(spark, sf_dir).select("doc_id", "facts", "stray", "multi_system", "n_families", "n_systems", "n_keywords", "drift", *[F.array_join(f"top_{c}", "|").alias(f"top_{c}") for c in C.TOP])


def drift_summary(spark, sf_dir):
    """Means over all documents of chunk_drift."""
    return C.cohesion_summary(_chunks(spark, sf_dir))


def quoted_name_sets(spark, sf_dir):
    """Names that facts of a source quote, by whether any clause denies them."""
    return C.name_sets(facts(spark, sf_dir), ["source"], "fact")


def intent_matches(spark, sf_dir):
    """Turns by role, intent and the pattern that told it."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return table(spark, sf_dir, "conversations").select("role", C.intent_of(key, RULES).alias("i")).groupBy("role", "i.intent", "i.matched_by").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (chunk_drift, drift_summary, quoted_name_sets, intent_matches)}

_KINDS = ("families", "systems", "keywords")
_DRIFT = (
    ", f AS MATERIALIZED (SELECT doc_id, " + ", ".join(f"list_distinct(list_filter(coalesce({c}, []), lambda x: x <> '')) AS {c}" for c in _KINDS) + " FROM record WHERE drop_reason IS NULL AND doc_id IS NOT NULL)"
    ", e AS (SELECT doc_id, kind, entry, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS kind, unnest({c}) AS entry FROM f" for c in _KINDS) + ") GROUP BY 1, 2, 3)"
    ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, entry) AS rn FROM e)"
    ", b AS (SELECT doc_id, " + ", ".join(f"count_if(kind = '{c}') AS n_{c}" for c in _KINDS) + ", " + ", ".join(f"coalesce(list(entry ORDER BY rn) FILTER (kind = '{c}' AND rn <= {k}), []) AS top_{c}" for c, k in C.TOP.items()) + " FROM r GROUP BY 1)"
    ", c AS (SELECT f.doc_id, count(*) AS facts, count_if(NOT list_has_any(families, coalesce(top_families, [])) AND NOT list_has_any(keywords, coalesce(top_keywords, []))) AS stray, count_if(len(systems) > 1) AS multi_system, "
    + ", ".join(f"coalesce(any_value(n_{c}), 0) AS n_{c}" for c in _KINDS) + ", " + ", ".join(f"coalesce(array_to_string(any_value(top_{c}), '|'), '') AS top_{c}" for c in C.TOP) + " FROM f LEFT JOIN b USING (doc_id) GROUP BY 1)"
    ", d AS (SELECT *, (stray * 2000 + facts) // (2 * facts) AS drift FROM c)"
)
_FLAT = [(n, p) for n, _, ps in sorted(RULES, key=lambda r: r[1]) for p in ps]
_HIT = [f"contains(key, '{p}')" if " " in p else f"contains(' ' || key || ' ', ' {p} ')" for _, p in _FLAT]
_PICK = lambda values, other: "CASE " + " ".join(f"WHEN {h} THEN '{v}'" for h, v in zip(_HIT, values, strict=True)) + f" ELSE {other} END"

SQL = {
    "chunk_drift": _RECORD + _DRIFT + " SELECT doc_id, facts, stray, multi_system, n_families, n_systems, n_keywords, CAST(drift AS BIGINT) AS drift, top_families, top_keywords FROM d",
    "drift_summary": _RECORD + _DRIFT + " SELECT count(*) AS chunks, " + ", ".join(f"coalesce(round(sum({c}) / count(*), 6), 0) AS mean_{n}" for n, c in (("keywords", "n_keywords"), ("families", "n_families"), ("systems", "n_systems"), ("facts", "facts"), ("drift", "drift"))) + ", coalesce(round(sum(multi_system) / nullif(sum(facts), 0), 6), 0) AS multi_system_share FROM d",
    "intent_matches": r"WITH k AS (SELECT role, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM conversations) SELECT role, " + f"{_PICK([n for n, _ in _FLAT], repr('unknown'))} AS intent, {_PICK([p for _, p in _FLAT], 'NULL')} AS matched_by, count(*) AS n FROM k GROUP BY 1, 2, 3",
}
