"""Queries over two runs of records and over answers; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import answers as A
from factloom.operators import compare as C
from factloom.operators import mechanics as M
from factloom.plans import mechanic_queries as Q
from factloom.plans.fact_queries import _TOK
from factloom.sources.tables import table, written


def _sides(spark, sf_dir):
    """Kept facts of even and odd documents by signature."""
    kept = written(Q.records(spark, sf_dir).where("drop_reason IS NULL").select("doc_id", "pos", "lang", "score_a", "core_key", *C.KEPT), "kept")
    return C.by_signature(kept.where("doc_id % 2 = 0")), C.by_signature(kept.where("doc_id % 2 = 1"))


def signature_groups(spark, sf_dir):
    """Facts by the key of their core: how many, how many entities, and the one that stands for them."""
    a, b = _sides(spark, sf_dir)
    out = a.withColumn("side", F.lit("base")).unionByName(b.withColumn("side", F.lit("current")))
    return out.select("side", "core_key", F.col("n").cast("bigint").alias("n"), F.col("n_entities_all").cast("bigint").alias("n_entities"), "doc_id", F.col("pos").cast("bigint").alias("pos"))


def equivalence_pairs(spark, sf_dir):
    """For signatures that the base alone has, the most equivalent one of the current run, with all parts."""
    a, b = _sides(spark, sf_dir)
    missing = a.join(b.select("core_key"), "core_key", "left_anti")
    return C.best_equivalents(missing, b)


def drift_levels(spark, sf_dir):
    """Metrics of two runs: shares, counts and totals, their difference and how far they drifted."""
    r = Q.records(spark, sf_dir).where("drop_reason IS NULL").select((F.col("doc_id") % 2).alias("run"), "anchor", "structural", "layer", "t_advice", "n_sentences", F.length("fact").alias("chars"))
    g = r.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(c)).alias(n) for n, c in (("a", "layer = 'A'"), ("b", "layer = 'B'"), ("anchor", "anchor"), ("structural", "structural"), ("advice", "t_advice"))])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("v")) for m, v in (("totals.facts", F.col("n")), ("totals.factsA", F.col("a")), ("totals.factsB", F.col("b")), ("metrics.grounding.anchorShare", F.col("anchor") / F.col("n")), ("metrics.representation.structuralShare", F.col("structural") / F.col("n")), ("metrics.grounding.adviceShare", F.col("advice") / F.col("n")), ("metrics.canonical.anchored", F.col("anchor")))])
    m = g.select("run", F.explode(pairs).alias("p")).select("run", "p.metric", "p.v")
    # one pass over both runs: a join of them would make the records twice
    side = lambda k: F.max(F.when(F.col("run") == k, F.col("v")))
    j = m.groupBy("metric").agg(side(0).alias("before"), side(1).alias("after")).where("before IS NOT NULL AND after IS NOT NULL")
    j = j.withColumn("delta", F.col("after") - F.col("before"))
    return j.select("metric", "before", "after", F.round("delta", 6).alias("delta"), F.expr(C.drift_sql("metric", "before", "delta")).alias("level"))


def drift_histogram(spark, sf_dir):
    """How many metrics drifted how far."""
    return drift_levels(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def model_routes(spark, sf_dir):
    """Turns by role and the reasons for the stronger model."""
    c = table(spark, sf_dir, "conversations").select("role", F.array_join(A.model_reasons("text", F.lit(False)), "+").alias("reasons"))
    return c.groupBy("role", "reasons").agg(F.count(F.lit(1)).alias("n"))


def answer_checks(spark, sf_dir):
    """Answers by whether they are too generic at level 2 for a context, and by their mode of knowledge."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    risky = A.high_risk("text", F.when(F.col("turn") % 5 == 0, F.lit("bug")))
    mode = A.knowledge_mode(F.col("turn") % 2, F.col("conv_id") % 3 > 0, F.when(F.col("conv_id") % 7 == 0, "C").otherwise("A"), risky)
    return c.groupBy(A.too_generic(F.col("text"), F.lit("the and"), F.lit(2)).alias("generic"), mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def prompts(spark, sf_dir):
    """A prompt for each conversation: its first two answers as facts, the question last, and the notice of its mode."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id", "role").orderBy("turn", "text")
    top = c.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    g = top.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("rn", F.col("text").alias("t"))))).alias("f"), F.min(F.when((F.col("role") == "user") & (F.col("rn") == 1), F.col("text"))).alias("q"))
    facts = A.facts_prompt(F.transform("f", lambda x: x["t"]))
    return g.select("conv_id", A.with_notice(A.assemble({"facts": facts, "question": F.col("q")}, ["facts", "question"]), F.when(F.size("f") > 0, "VERIFIED").otherwise("UNKNOWN"), F.lit("en")).alias("prompt"))


def scored_facts(spark, sf_dir):
    """Benchmark items as facts, scored for the first question of each conversation: the best three by full score.

    A fact that scores shares a token's first three letters with the question, so only such pairs are scored; a hot
    beginning has at most as many pairs as there are benchmark items, a list of fixed size.
    """
    q = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).select("conv_id", X.text_key("question").alias("question"), X.token_set("question").alias("tokens"))
    b = table(spark, sf_dir, "benchmark").select("item_id", X.token_set("text").alias("own"), F.slice(X.token_set("text", 6), 1, 4).alias("keywords"), (F.col("item_id") % 3 + 1).alias("priority"))
    start = lambda c: F.array_distinct(F.transform(c, lambda t: F.substring(t, 1, 3)))
    pairs = q.select("conv_id", F.explode(start("tokens")).alias("s")).join(b.select("item_id", F.explode(start("own")).alias("s")), "s").select("conv_id", "item_id").distinct()
    scored = pairs.join(q, "conv_id").join(b, "item_id").select("conv_id", "item_id", A.fact_score(F.col("keywords"), F.lit(None).cast("array<string>"), F.col("own"), F.col("question"), F.col("tokens"), F.lit(None).cast("string"), F.col("priority")).alias("score"))
    w = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "item_id")
    return scored.where("score > 0").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("conv_id", "item_id", (F.col("score") * 10).cast("bigint").alias("score10"), F.col("rn").cast("bigint").alias("rn"))


QUERIES = {f.__name__: f for f in (signature_groups, equivalence_pairs, drift_levels, drift_histogram, model_routes, answer_checks, prompts, scored_facts)}

_SIDE = "(SELECT core_key, doc_id, pos, n, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY core_key ORDER BY -score_a, doc_id, pos) AS rn, count(*) OVER (PARTITION BY core_key) AS n FROM kept WHERE {where}) WHERE rn = 1)"
_KEPT = Q._RECORD + ", kept AS MATERIALIZED (SELECT doc_id, pos, lang, score_a, core_key, " + ", ".join(C.KEPT) + " FROM record WHERE drop_reason IS NULL), base AS " + _SIDE.format(cols=", ".join(C.KEPT), where="doc_id % 2 = 0") + ", curr AS " + _SIDE.format(cols=", ".join(C.KEPT), where="doc_id % 2 = 1")


def _jaccard_sql(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / {union} END"


def _tags_sql(c: str) -> str:
    return f"list_filter(string_split({c}, '+'), lambda x: x <> '')"


_SCORED = ", p0 AS (SELECT m.core_key, c.core_key AS other, " + ", ".join(f"m.{k} AS a_{k}, c.{k} AS b_{k}" for k in C.KEPT) + " FROM base m, curr c WHERE m.core_key NOT IN (SELECT core_key FROM curr)), p1 AS (SELECT *, " + ", ".join(f"{_jaccard_sql(f'a_{k}', f'b_{k}')} AS j_{k}" for k in ("entities", "systems", "families")) + f", {_jaccard_sql(_tags_sql('a_role_tags'), _tags_sql('b_role_tags'))} AS j_roles, len(list_intersect(a_entities, b_entities)) AS n_entities_both FROM p0)"
for _k, _level in enumerate(C.LEVELS):
    _taken = " EXCLUDE (" + ", ".join(n for n in _level if any(n in x for x in C.LEVELS[:_k])) + ")" if any(n in x for n in _level for x in C.LEVELS[:_k]) else ""
    _SCORED += f", p{_k + 2} AS (SELECT *{_taken}, " + ", ".join(f"({e}) AS {n}" for n, e in _level.items()) + f" FROM p{_k + 1})"
_SCORED += f", sc AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in C.OVERLAPS.items()) + f" FROM p{len(C.LEVELS) + 1})"

_METRICS = Q._RECORD + ", g AS (SELECT doc_id % 2 AS run, count(*) AS n, count_if(layer = 'A') AS a, count_if(layer = 'B') AS b, count_if(anchor) AS anchor, count_if(structural) AS structural, count_if(t_advice) AS advice FROM record WHERE drop_reason IS NULL GROUP BY 1), m AS (" + " UNION ALL ".join(f"SELECT run, '{m}' AS metric, CAST({v} AS DOUBLE) AS v FROM g" for m, v in (("totals.facts", "n"), ("totals.factsA", "a"), ("totals.factsB", "b"), ("metrics.grounding.anchorShare", "anchor / n"), ("metrics.representation.structuralShare", "structural / n"), ("metrics.grounding.adviceShare", "advice / n"), ("metrics.canonical.anchored", "anchor"))) + "), j AS (SELECT x.metric, x.v AS before, y.v AS after, y.v - x.v AS delta FROM m x JOIN m y ON x.metric = y.metric AND x.run = 0 AND y.run = 1), d AS (SELECT metric, before, after, round(delta, 6) AS delta, " + C.drift_sql("metric", "before", "delta") + " AS level FROM j)"
_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
_PARTS = lambda c, parts: "(" + " OR ".join(f"contains(lower({c}), '{p}')" for p in parts) + ")"
_REASONS = f"concat_ws('+', CASE WHEN length(text) >= {A.LONG_CHARS} OR {_WORDS} >= {A.LONG_WORDS} THEN 'long-input' END, CASE WHEN length(text) - length(replace(text, ',', '')) >= {A.LIST_COMMAS} THEN 'list-heavy' END, CASE WHEN {_PARTS('text', A.TROUBLE)} THEN 'troubleshoot' END, CASE WHEN regexp_matches(text, '(?i)\\bmod(s|ok|ded|ding)?\\b') THEN 'mod-support' END, CASE WHEN {_PARTS('text', A.TURNS)} THEN 'multi-turn' END)"
_BEGINS = "len(list_filter(tokens, lambda t: starts_with(t, w) OR starts_with(w, t))) > 0"

SQL = {
    "signature_groups": _KEPT + ", e AS (SELECT 'base' AS side, core_key, unnest(entities) AS e FROM kept WHERE doc_id % 2 = 0 UNION ALL SELECT 'current', core_key, unnest(entities) FROM kept WHERE doc_id % 2 = 1), k AS (SELECT side, core_key, count(DISTINCT e) AS n_entities FROM e GROUP BY 1, 2), b AS (SELECT 'base' AS side, core_key, n, doc_id, pos FROM base UNION ALL SELECT 'current', core_key, n, doc_id, pos FROM curr) SELECT side, core_key, n, coalesce(n_entities, 0) AS n_entities, doc_id, pos FROM b LEFT JOIN k USING (side, core_key)",
    "equivalence_pairs": _KEPT + _SCORED + " SELECT core_key, other, score, entity, shape, condition_effect, transition, consequence, operational, representation, continuity, loss, core_overlap, shape_overlap FROM (SELECT *, row_number() OVER (PARTITION BY core_key ORDER BY -score, other) AS rn FROM sc) WHERE rn = 1",
    "drift_levels": _METRICS + " SELECT * FROM d", "drift_histogram": _METRICS + " SELECT level, count(*) AS n FROM d GROUP BY 1",
    "model_routes": f"SELECT role, {_REASONS} AS reasons, count(*) AS n FROM conversations GROUP BY 1, 2",
    "answer_checks": f"SELECT trim(text) <> '' AND NOT contains(lower(trim(text)), 'the and') AND length(trim(text)) < {A.LEAST_CHARS[2]} AS generic, CASE WHEN conv_id % 7 = 0 OR turn % 5 = 0 OR {_PARTS('text', A.RISKY)} THEN 'UNKNOWN' WHEN turn % 2 > 0 THEN 'VERIFIED' WHEN conv_id % 3 > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS mode, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2",
    "prompts": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS rn FROM conversations), g AS (SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY rn) FILTER (WHERE role = 'assistant') AS f, min(text) FILTER (WHERE role = 'user' AND rn = 1) AS q FROM t WHERE rn <= 2 GROUP BY 1), p AS (SELECT conv_id, f, trim(concat_ws(chr(10) || chr(10), trim('Facts:' || chr(10) || f), nullif(trim(q), ''))) AS body FROM g) SELECT conv_id, CASE WHEN body = '' OR f IS NOT NULL THEN body ELSE body || chr(10) || chr(10) || 'This is not verified.' END AS prompt FROM p",
    "scored_facts": f"""WITH q AS (SELECT conv_id, trim(regexp_replace(lower(arg_min(text, turn)), '\\s+', ' ', 'g')) AS question, list_distinct({_TOK.format('arg_min(text, turn)', 3)}) AS tokens FROM conversations WHERE role = 'user' GROUP BY 1),
      b AS (SELECT item_id, {M._sql_first(_TOK.format('text', 3))} AS own, ({M._sql_first(_TOK.format('text', 6))})[1:4] AS keywords, item_id % 3 + 1 AS priority FROM benchmark),
      h AS (SELECT conv_id, item_id, priority, len(list_filter(keywords, lambda w: list_contains(tokens, w) OR {_BEGINS})) AS k, least(4, len(list_filter(own, lambda w: list_contains(tokens, w) OR (length(w) >= 4 AND {_BEGINS})))) AS o FROM q, b),
      s AS (SELECT conv_id, item_id, CASE WHEN k > 0 THEN 2 * k ELSE o END AS p, [3, 6, 10][priority] AS w FROM h), r AS (SELECT conv_id, item_id, CAST(p * 10 + w AS BIGINT) AS score10, row_number() OVER (PARTITION BY conv_id ORDER BY p * 10 + w DESC, item_id) AS rn FROM s WHERE p > 0) SELECT conv_id, item_id, score10, rn FROM r WHERE rn <= 3""",
}
