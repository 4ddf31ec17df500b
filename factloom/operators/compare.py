"""Two runs side by side: groups by signature, how equivalent their representatives are, what was lost, and drift.

Scores are SQL expressions over the columns of two records, a_ and b_, so that the SQL they are checked with is the
same.  Parts and scores are whole thousandths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a record that a comparison reads.
KEPT = ["entities", "has_condition", "has_effect", "g_transition", "core_constraint", "g_downstream", "structural", "coverage", "role_tags", "systems", "families", "layer", "final_priority", "g_chain", "g_failure_constraint"]

_FLAGS = ["has_condition", "has_effect", "g_transition", "core_constraint", "g_downstream", "structural", "coverage"]
_THOUSANDTHS = "CAST(floor(({0}) * 1000 + 0.5) AS BIGINT)"


def _equal(names: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN a_{n} = b_{n} THEN 1 ELSE 0 END" for n in names) + ")"


# How the parts of a score are made and weighed.
LEVELS = [
    {
        "entity": "j_entities", "shape": f"{_equal(_FLAGS)} / CAST(7 AS DOUBLE)", "condition_effect": f"{_equal(_FLAGS[:2])} / CAST(2 AS DOUBLE)", "transition": f"{_equal(['g_transition'])} * CAST(1 AS DOUBLE)",
        "consequence": f"{_equal(['has_effect', 'g_downstream', 'core_constraint'])} / CAST(3 AS DOUBLE)", "operational": "(j_roles + j_systems + j_families) / CAST(3 AS DOUBLE)",
        "representation": f"({_equal(['layer', 'final_priority'])} + j_families + j_systems + j_roles) / CAST(5 AS DOUBLE)",
    },
    {**{n: _THOUSANDTHS.format(n) for n in ("entity", "shape", "condition_effect", "transition", "consequence", "operational", "representation")}, "continuity": _THOUSANDTHS.format("condition_effect * CAST(0.25 AS DOUBLE) + transition * CAST(0.2 AS DOUBLE) + consequence * CAST(0.2 AS DOUBLE) + j_roles * CAST(0.15 AS DOUBLE) + j_systems * CAST(0.1 AS DOUBLE) + j_families * CAST(0.1 AS DOUBLE)")},
    {"score": "(200 * entity + 200 * shape + 150 * condition_effect + 100 * transition + 100 * consequence + 150 * operational + 100 * representation + 500) // 1000"},
    {
        "loss": "CASE WHEN score >= 750 AND entity >= 600 AND operational >= 600 THEN 'preserved' WHEN score >= 600 AND shape >= 800 AND entity < 400 THEN 'shape-transformed' WHEN score >= 450 AND (entity >= 300 OR operational >= 300) THEN 'partial-recovery' WHEN score >= 400 AND operational >= 400 AND representation < 600 THEN 'semantic-drift' WHEN score >= 350 AND shape >= 700 AND entity < 200 THEN 'synthetic-substitution' ELSE 'mechanic-loss' END",
    },
]
_BOTH = lambda names: " + ".join(f"CASE WHEN a_{n} AND b_{n} THEN 1 ELSE 0 END" for n in names)
_EITHER = lambda names: " + ".join(f"CASE WHEN a_{n} OR b_{n} THEN 1 ELSE 0 END" for n in names)
_CORE, _SHAPE = ["has_condition", "has_effect", "g_transition", "core_constraint", "g_downstream"], ["has_condition", "has_effect", "g_transition", "g_downstream", "g_chain", "g_failure_constraint"]
#: Overlap of cores (entities and flags) and of shapes (flags alone), as clusters are made by.
OVERLAPS = {
    "core_overlap": _THOUSANDTHS.format(f"CASE WHEN n_entities_both > 0 THEN j_entities * CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN {_EITHER(_CORE)} > 0 THEN CAST(0.4 AS DOUBLE) * ({_BOTH(_CORE)}) / ({_EITHER(_CORE)}) ELSE CAST(0 AS DOUBLE) END"),
    "shape_overlap": _THOUSANDTHS.format(f"CASE WHEN {_EITHER(_SHAPE)} > 0 THEN CAST(1 AS DOUBLE) * ({_BOTH(_SHAPE)}) / ({_EITHER(_SHAPE)}) ELSE CAST(0 AS DOUBLE) END"),
}

# From which difference on a metric has drifted how far: shares, counts, and single metrics.
THRESHOLDS = {"ratio": [0.01, 0.03, 0.06, 0.1], "count": [1, 5, 10, 20], "override": [2, 6, 12, 25]}
OVERRIDDEN = ["totals.facts", "totals.factsA", "totals.factsB"]
DRIFT = ["minor-drift", "notable-drift", "regression-risk", "architecture-break"]


def drift_sql(metric: str, before: str, delta: str) -> str:
    """The level of a difference: by the metric's own thresholds, those of counts for whole numbers, or those of shares."""
    kind = {n: "CASE " + " ".join(f"WHEN round(abs({delta}), 6) >= {t} THEN '{level}'" for t, level in reversed(list(zip(v, DRIFT, strict=True)))) + " ELSE 'stable' END" for n, v in THRESHOLDS.items()}
    names = ", ".join(f"'{m}'" for m in OVERRIDDEN)
    return f"CASE WHEN {metric} IN ({names}) THEN {kind['override']} WHEN {before} = floor({before}) THEN {kind['count']} ELSE {kind['ratio']} END"


def by_signature(records: DataFrame) -> DataFrame:
    """One row for each core key: facts, all entities, and the record of the fact that scores best as deep knowledge,
    the first on equal scores.  There are no more keys than combinations of seven counts and six flags."""
    order = F.struct((-F.col("score_a")).alias("s"), "doc_id", "pos", F.struct(*[c for c in KEPT if c != "entities"]).alias("r"))
    g = records.groupBy("core_key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("b"))
    all_ = records.select("core_key", F.explode("entities").alias("e")).distinct().groupBy("core_key").agg(F.count(F.lit(1)).alias("n_entities_all"))
    own = records.select("core_key", "score_a", "doc_id", "pos", "entities")
    best = g.select("core_key", F.col("b.doc_id").alias("doc_id"), F.col("b.pos").alias("pos"), "n", F.col("b.r").alias("r"))
    return best.join(own.select("core_key", "doc_id", "pos", "entities"), ["core_key", "doc_id", "pos"]).join(all_, "core_key", "left").select("core_key", "doc_id", "pos", "n", F.coalesce("n_entities_all", F.lit(0)).alias("n_entities_all"), "entities", "r.*")


def _jaccard(a, b):
    """The share of what either list has that both have; 1 where both are empty."""
    a, b = (F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))) for x in (a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pairs of records (a_ and b_ before each column of KEPT) with the parts, scores, loss and overlaps."""
    tags = lambda c: F.filter(F.split(c, "[+]"), lambda x: x != "")
    out = pairs.withColumns({"j_entities": _jaccard(F.col("a_entities"), F.col("b_entities")), "j_systems": _jaccard(F.col("a_systems"), F.col("b_systems")), "j_families": _jaccard(F.col("a_families"), F.col("b_families")), "j_roles": _jaccard(tags("a_role_tags"), tags("b_role_tags")), "n_entities_both": F.size(F.array_intersect("a_entities", "b_entities"))})
    for level in LEVELS:
        out = out.withColumns({n: F.expr(e.replace("//", "DIV")) for n, e in level.items()})
    return out.withColumns({n: F.expr(e) for n, e in OVERLAPS.items()})


def best_equivalents(missing: DataFrame, added: DataFrame) -> DataFrame:
    """For each signature of `missing` its most equivalent one of `added`, the first by key on equal scores.

    Both sides have one row a signature (by_signature), which bounds the pairs whatever the number of facts; a side
    without rows gives none.
    """
    a = missing.select("core_key", *[F.col(c).alias(f"a_{c}") for c in KEPT])
    b = added.select(F.col("core_key").alias("other"), *[F.col(c).alias(f"b_{c}") for c in KEPT])
    scored = score_pairs(a.crossJoin(F.broadcast(b)))  # a row a signature: some hundreds at most
    parts = ["entity", "shape", "condition_effect", "transition", "consequence", "operational", "representation", "continuity", "loss", "core_overlap", "shape_overlap"]
    best = scored.groupBy("core_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "other", F.struct(*parts).alias("p"))).alias("b"))
    return best.select("core_key", F.col("b.other").alias("other"), (-F.col("b.s")).alias("score"), "b.p.*")
