"""Phrases: one pass over words against the regular expressions, and a phrase of every category by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import mechanics as M
from factloom.operators.phrases import Phrases, once, words

#: category: a text that has one of its phrases of several words, and one that only has the words.
CASES = {
    "tutorial": ("Open the build menu", "The menu is open"), "generic": ("It may lead to losses", "To lead in May"), "lore_narrative": ("Once upon a time it stood", "Upon this once"), "gameplay": ("It fires 3 per second", "Second per capita"),
    "non_actionable": ("It first appeared in the old days", "Appeared first in the days"), "wiki_editorial": ("View source here", "Source of the view"), "time_bound": ("As of 2021 it works", "As of old it works"), "evergreen_mechanic": ("It holds regardless of heat", "Regardless it holds"),
    "live_service": ("Weekly quests give more", "A quest each weekly"), "impact": ("It cuts the wait by half", "By half it cuts"), "cosmetic": ("This is purely cosmetic", "Cosmetic, purely so"), "low_signal": ("It requires more raw materials", "Materials that it requires"),
    "weak_tradeoff": ("It improves aim but costs time", "But time improves aim"), "evergreen_tighten": ("It is off at the moment", "The moment it is at"), "emergent": ("One leak causes the next", "The next leak causes one"), "tradeoff": ("More heat at the cost of speed", "The cost at heat of speed"),
    "specificity": ("It takes up to 12", "Up it takes to the"), "ability": ("An active effect", "Effect is active"), "implication": ("As a result it stops", "A result as such"), "optimization": ("It is best placed near heat", "Placed best"), "multi_step": ("First heat the core and then cool it", "Core first"),
    "deep": ("In the long run it pays", "The long pipe in run"), "scaling": ("It grows with heat", "With it grows"), "failure": ("It runs out of heat", "Out of it runs"), "shallow": ("Just build it", "Build just"), "resource": ("It consumes 3 logs per", "Per what it consumes"), "supporting": ("In general it holds", "General in command"),
    "systemic": ("A feedback loop", "Loop of feedback"), "spread": ("The entire core", "Entire the core"), "builder": ("A good floor plan", "Plan the floor"), "builder_obvious": ("Place a door", "Door to a place"), "condition": ("It works as long as heat lasts", "As long it works"),
    "gating": ("It is locked behind heat", "Behind it is locked"), "state_change": ("Iron turns into rust", "Into it turns"), "transition": ("It moves from hot to cold", "To hot from cold"), "downstream": ("Which then stops the core", "Then which"), "chain": ("It waits for heat", "For it waits"),
    "failure_constraint": ("It no longer works", "Longer no"), "causal": ("It is off due to heat", "To due dates"), "narration": ("You find yourself lost", "Find you yourself"), "advice": ("Try to heat it", "To try"), "continuity": ("It keeps running", "Running keeps it"), "dependency": ("It relies on heat", "On it relies"),
    "routing": ("Heat is sent to it", "To it heat is sent"), "recovery": ("It comes back", "Back it comes"), "interruption": ("A power outage", "Outage of power"), "downstream_effect": ("It has an effect on heat", "Effect on it has"),
}


def test_a_phrase_of_every_category(spark):
    assert list(CASES) == M.CATEGORIES
    rows = [(c, hit, miss) for c, (hit, miss) in CASES.items()]
    df = spark.createDataFrame(rows, "c string, hit string, miss string")
    found = M.Policy().found
    got = {r.c: r for r in df.select("c", *[found.found(words(F.lower(x))).alias(x) for x in ("hit", "miss")]).collect()}
    for k, c in enumerate(M.CATEGORIES):
        assert got[c].hit.bits >> k & 1, c
        assert not got[c].miss.bits >> k & 1, c


def test_words_of_any_script(spark):
    p = Phrases({"a": ["für|está sie", "стоп", "ﾊ"], "b": ["naïve _1 mañana"]}, ["a"])
    df = spark.createDataFrame([("Für Sie",), ("está, sie! СТОП",), ("f r sie",), ("naïve (x) Mañana",), ("naïve x y mañana",), ("",), (None,)], "t string")
    got = [None if r.f is None else (r.f.bits, bin(r.f.own).count("1")) for r in df.select(p.found(words(F.lower("t"))).alias("f")).collect()]
    assert got == [(1, 1), (1, 2), (0, 0), (2, 0), (0, 0), (0, 0), None]


@pytest.mark.parametrize("seed", range(3))
def test_the_fold_finds_what_the_expressions_find(spark, seed):
    rnd = random.Random(seed)
    letters = list("abcd") + ["7"]
    token = lambda: rnd.choice(["a", "b", "c", "d", "a|b", "c|d", "#"])

    def phrase():
        out = [token()]
        for _ in range(rnd.randrange(4)):
            out += [f"_{rnd.randrange(4)}"] * rnd.randrange(2) + [token()]
        return " ".join(out)

    made = {c: list({phrase() for _ in range(5)}) for c in "uvwxyz"}
    p = Phrases(made, ["u", "v"])
    texts = [" ".join(rnd.choice([*letters, "e", "f"]) for _ in range(rnd.randrange(12))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", p.found(words(F.col("t"))).alias("f"))
    got = got.select("t", F.col("f.bits").alias("bits"), p.count(F.col("f.own"), "u").alias("u"), p.count(F.col("f.own"), "v").alias("v")).collect()
    for r in got:
        line = f" {r.t} "
        for k, c in enumerate(made):
            assert bool(r.bits >> k & 1) == any(re.search(p.pattern(x), line) for x in made[c]), (r.t, made[c])
        assert (r.u, r.v) == tuple(sum(bool(re.search(p.pattern(x), line)) for x in made[c]) for c in "uv")


def test_what_cannot_be_a_phrase():
    for bad in ("", "_3", "a _3"):
        with pytest.raises(ValueError):
            Phrases({"a": [bad]})
    with pytest.raises(ValueError):
        M.Policy({"unknown": ["a"]})


def test_words_are_looked_for_once(spark):
    """However many columns use it, the fold over a fact's words stands once in the plan, and once for the surroundings."""
    df = spark.createDataFrame([("if it turns into rust", "wiki", "if it turns into rust at once")], "fact string, source string, context string")
    record = M.with_record(df)
    for plan in (record.where("drop_reason IS NULL").groupBy("steps").agg(F.sum("score_a"), F.count_if("t_condition"), F.max("novelty")), record):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 4  # two nested folds
    assert df.select(once(F.col("fact")).alias("f")).first().f == "if it turns into rust"
