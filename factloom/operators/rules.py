"""Filter ladder and ordered score steps over candidate facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators.phrases import once

#: Lexicon by category: a parameter; these words suit plain prose.  Every category becomes one pattern.
LEXICON = {
    "tutorial": ["press", "click", "tutorial"], "generic": ["very good", "is useful", "be careful"], "lore": ["legend", "history", "story"], "time_bound": ["version", "patch", "update", "license"],
    "condition": ["if", "when", "unless", "for", "wenn", "para", "pour"], "effect": ["increases", "reduces", "is", "are", "ist", "est", "es"], "emergent": ["cascade", "that", "which", "que", "die"], "tradeoff": ["but", "however", "by", "with", "mit", "con"],
    "advice": ["should", "always", "never", "you"], "workflow": ["then", "next", "first", "to"], "failure": ["fails", "cannot", "not", "blocked"], "multi_step": ["and", "und", "et"],
}
MAX_CHARS = 240


def matches(category: str, fact: str = "fact", lexicon: dict | None = None) -> Column:
    return F.lower(F.col(fact)).rlike(X.words_pattern((lexicon or LEXICON)[category]))


def with_flags(facts: DataFrame, fact: str = "fact", lexicon: dict | None = None) -> DataFrame:
    """One boolean column m_<category> for each lexicon category; all are null where the fact is.

    The fact is split into words once and each word looked up once; entries of several words are looked for only
    where they stand in the text.  Columns of these names are replaced.
    """
    lexicon = lexicon or LEXICON
    masks: dict[str, int] = {}
    for k, words in enumerate(lexicon.values()):
        for w in words:
            if " " not in w:
                masks[w] = masks.get(w, 0) | 1 << k
    table = F.create_map(*[F.lit(x) for w, m in masks.items() for x in (w, m)])
    hits = F.filter(F.split(F.lower(F.col(fact)), "[^a-z0-9_]+"), lambda w: w.isin(list(masks)))
    facts = facts.withColumn("_bits", once(F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, w: a.bitwiseOR(table[w].cast("bigint")))))
    out = {}
    for k, (c, words) in enumerate(lexicon.items()):
        out[f"m_{c}"] = F.col("_bits").bitwiseAND(F.lit(1 << k)) != 0
        if several := [w for w in words if " " in w]:
            there = F.lit(False)
            for w in several:
                there = there | F.contains(F.lower(F.col(fact)), F.lit(w))
            out[f"m_{c}"] = out[f"m_{c}"] | (there & F.lower(F.col(fact)).rlike(X.words_pattern(several)))
    return facts.withColumns(out).drop("_bits")


def drop_reason(fact: str = "fact", blocked: list[str] | None = None) -> Column:
    """The first rule that a fact fails, or null: missing, too long, blocked words, tutorial, generic, time-bound
    without emergent or tradeoff words, low signal without them.  Reads the columns of with_flags."""
    f, low = F.col(fact), F.lower(F.col(fact))
    guard = F.col("m_emergent") | F.col("m_tradeoff")
    blocked_any = F.lit(False)
    for w in blocked if blocked is not None else ["lore", "story"]:
        blocked_any = blocked_any | F.contains(low, F.lit(w))
    return (
        F.when(f.isNull() | (f == ""), "missing-text").when(F.length(f) > MAX_CHARS, "text-too-long").when(blocked_any, "lore-pattern")
        .when(F.col("m_tutorial"), "tutorial-pattern").when(F.col("m_generic"), "generic-pattern")
        .when(F.col("m_time_bound") & ~guard, "time-bound-metadata").when((F.size(X.token_set(fact, 4)) < 2) & ~guard, "low-signal")
    )


def source_reason(source: str = "source", allow: list[str] | None = None, block: list[str] | None = None, patterns: list[str] | None = None) -> Column:
    s = F.lower(F.trim(F.col(source)))
    hit = F.lit(False)
    for p in patterns or []:
        hit = hit | F.contains(s, F.lit(p))
    return F.when(s.isNull() | (s == ""), "source-type-missing").when(s.isin(block or ["__none__"]), "source-type-blocked").when(hit, "source-type-pattern").when(F.lit(bool(allow)) & ~s.isin(allow or ["__none__"]), "source-type-not-allowed")


#: Steps in their order: name, categories that must all match (a leading ! must not), change of novelty and of obviousness.
STEPS = [
    ("template", ["condition", "effect"], -.08, .14), ("specific", ["specific"], .1, -.05), ("emergent", ["emergent"], .15, -.1), ("tradeoff", ["tradeoff"], .08, -.04), ("multi_step", ["multi_step"], .08, -.05),
    ("failure", ["failure", "condition"], .12, -.06), ("workflow", ["workflow", "!emergent"], -.08, .12), ("advice", ["advice"], -.09, .09), ("unanchored", ["!condition", "!effect"], -.08, .08), ("time_bound", ["time_bound"], -.08, .1),
]


def with_scores(facts: DataFrame, steps: list = STEPS, novelty: str | None = None, obviousness: str | None = None) -> DataFrame:
    """novelty and obviousness after all steps, each clamped to 0..1 after every step, and the steps that applied.

    The steps are folded over an array, so the expression stays as long as the list of steps.  Null starts count
    as 0.5 and 0.4.  Reads the columns of with_flags, and makes them where they are not there.
    """
    facts = facts if f"m_{next(iter(LEXICON))}" in facts.columns else with_flags(facts)
    facts = facts.withColumn("m_specific", F.size(X.token_set("fact", 5)) >= 2)

    def applies(names: list[str]) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (~F.col(f"m_{n[1:]}") if n[0] == "!" else F.col(f"m_{n}"))
        return out

    deltas = F.filter(F.array(*[F.struct(F.lit(n).alias("step"), F.when(applies(c), 1).otherwise(0).alias("on"), F.lit(float(a)).alias("dn"), F.lit(float(b)).alias("do")) for n, c, a, b in steps]), lambda s: s["on"] == 1)
    start = F.struct(F.coalesce(X.clamp(novelty) if novelty else F.lit(None).cast("double"), F.lit(0.5)).alias("n"), F.coalesce(X.clamp(obviousness) if obviousness else F.lit(None).cast("double"), F.lit(0.4)).alias("o"))
    one = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    end = F.aggregate(F.col("score_steps"), start, lambda a, s: F.struct(one(a["n"] + s["dn"]).alias("n"), one(a["o"] + s["do"]).alias("o")))
    return facts.withColumn("score_steps", deltas).withColumn("_end", end).select("*", F.col("_end.n").alias("novelty"), F.col("_end.o").alias("obviousness")).drop("_end")


def final_priority(base: Column, novelty: Column, obvious: Column) -> Column:
    """Obvious facts are capped, novel ones lifted; 3 is the top."""
    capped = F.when(obvious > .75, F.least(base, F.lit(1))).when(obvious > .6, F.least(base, F.lit(2))).otherwise(base)
    return F.least(F.lit(3), F.greatest(F.lit(1), F.when((novelty >= .75) & (obvious < .4), capped + 1).otherwise(capped)))
