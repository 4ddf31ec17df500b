"""Retention scores of facts with the terms they are made of, knowledge layers, and shares by layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import rules

#: Terms: name, lexicon categories that must all match (a leading ! must not), points in hundredths.  Parameters.
DEEP = [("emergent", ["emergent"], 15), ("tradeoff", ["tradeoff"], 12), ("failure", ["failure"], 12), ("grounded", ["condition", "effect"], 10), ("multi_step", ["multi_step"], 8), ("workflow", ["workflow", "!emergent"], -8), ("advice", ["advice"], -9), ("time_bound", ["time_bound"], -10), ("tutorial", ["tutorial"], -20), ("generic", ["generic"], -20)]
SUPPORT = [("advice", ["advice"], 10), ("workflow", ["workflow"], 12), ("effect", ["effect"], 6), ("tutorial", ["tutorial"], 5), ("generic", ["generic"], -10), ("lore", ["lore"], -20)]


def holds(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (~F.col(f"m_{n[1:]}") if n[0] == "!" else F.col(f"m_{n}"))
    return out


def terms(parts: list) -> Column:
    """The terms that hold, in order, with their points."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("term"), F.when(holds(c), p).otherwise(0).cast("bigint").alias("points")) for n, c, p in parts]), lambda t: t["points"] != 0)


def score(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, t: a + t["points"])


def with_retention(facts: DataFrame) -> DataFrame:
    """terms_a, terms_b, score_a, score_b and layer.

    Layer A holds what is emergent or a tradeoff with an effect, and all that scores no less as deep than as
    supporting knowledge; the rest is layer B.  A null text has no flags, hence no terms, and is in layer A.
    """
    flagged = rules.with_flags(facts.withColumn("fact", F.coalesce("fact", F.lit(""))))
    scored = flagged.withColumns({"terms_a": terms(DEEP), "terms_b": terms(SUPPORT)}).withColumns({"score_a": score(F.col("terms_a")), "score_b": score(F.col("terms_b"))})
    anchored = (F.col("m_emergent") | F.col("m_tradeoff")) & F.col("m_effect")
    return scored.withColumn("layer", F.when(anchored | (F.col("score_a") >= F.col("score_b")), "A").otherwise("B"))


def failed_rules(parts: list) -> Column:
    """Names of all rules that a fact fails, not the first alone."""
    return F.array_compact(F.array(*[F.when(holds(c), n) for n, c in parts]))
