"""Comparison of records and what goes into answers, on rows made by hand."""

from pyspark.sql import functions as F

from factloom.operators import answers as A
from factloom.operators import compare as C

FLAGS = "has_condition boolean, has_effect boolean, g_transition boolean, core_constraint boolean, g_downstream boolean, structural boolean, coverage int"
SCHEMA = f"core_key string, entities array<string>, {FLAGS}, role_tags string, systems array<string>, families array<string>, layer string, final_priority int, g_chain boolean, g_failure_constraint boolean"


def row(key, entities, flags, roles="workflow", layer="A", priority=2):
    on = [c in flags for c in "CETKDS"]
    return (key, entities, *on, len(flags), roles, entities[:1], [], layer, priority, "K" in flags, False)


def test_equivalence_by_hand(spark):
    missing = spark.createDataFrame([row("m1", ["a", "b"], "CE"), row("m2", [], "", roles="")], SCHEMA)
    added = spark.createDataFrame([row("x1", ["a", "b"], "CE"), row("x2", ["c"], "TD", roles="operational", layer="B", priority=1), row("x0", ["a", "b"], "CE")], SCHEMA)
    got = {r.core_key: r for r in C.best_equivalents(missing, added).collect()}
    # the same record: all parts whole; of two alike the first key
    assert (got["m1"].other, got["m1"].score, got["m1"].loss, got["m1"].continuity, got["m1"].core_overlap, got["m1"].shape_overlap) == ("x0", 1000, "preserved", 1000, 1000, 1000)
    # against x2: no entity, 4 of 7 flags and counts, both of C and E, not T, E and K of three, families alone of three lists, one of five
    only = C.best_equivalents(missing.where("core_key = 'm2'"), added.where("core_key = 'x2'")).first()
    assert (only.entity, only.shape, only.condition_effect, only.transition, only.consequence, only.operational, only.representation) == (0, 571, 1000, 0, 667, 333, 200)
    assert only.score == (200 * 571 + 150 * 1000 + 100 * 667 + 150 * 333 + 100 * 200 + 500) // 1000 and only.loss == "mechanic-loss" and only.core_overlap == 0
    assert C.best_equivalents(missing.limit(0), added).collect() == [] and C.best_equivalents(missing, added.limit(0)).collect() == []


def test_drift_levels(spark):
    rows = [("totals.facts", 10.0, 1.0, "stable"), ("totals.facts", 10.0, -25.0, "architecture-break"), ("m.count", 10.0, 1.0, "minor-drift"), ("m.count", 10.0, 5.0, "notable-drift"), ("m.count", 10.0, 10.0, "regression-risk"), ("m.count", 10.0, 20.0, "architecture-break"), ("m.share", 0.5, 0.0099, "stable"), ("m.share", 0.5, 0.01, "minor-drift"), ("m.share", 0.5, -0.03, "notable-drift"), ("m.share", 0.5, 0.06, "regression-risk"), ("m.share", 0.5, 0.1, "architecture-break"), ("m.share", 1.0, 0.06, "stable")]
    df = spark.createDataFrame(rows, "metric string, before double, delta double, want string").withColumn("got", F.expr(C.drift_sql("metric", "before", "delta")))
    assert all(r.got == r.want for r in df.collect()), df.where("got <> want").collect()


def values(spark, schema, rows, column):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"i int, {schema}")
    return [r.o for r in df.select("i", column.alias("o")).orderBy("i").collect()]


def test_routes_and_modes(spark):
    rows = [("short", False), ("x" * 100, False), ("a,b,c,d,e,f,g,h,i", False), ("it has a crash", True), ("modded load order", False), ("as before", None), (None, None)]
    assert values(spark, "t string, i2 boolean", rows, F.array_join(A.model_reasons("t", "i2"), "+")) == ["", "long-input", "list-heavy", "has-image+troubleshoot", "mod-support", "multi-turn", ""]
    assert values(spark, "t string, n string", [("x", "bug"), ("how to delete it", None), ("x", " spoiler "), (None, None)], A.high_risk("t", "n")) == [True, True, True, False]
    rows = [(1, True, "A", False), (0, True, "A", False), (0, False, "B", False), (1, True, "C", False), (1, True, "A", True)]
    assert values(spark, "n int, c boolean, t string, r boolean", rows, A.knowledge_mode(F.col("n"), F.col("c"), F.col("t"), F.col("r"))) == ["VERIFIED", "PARTIAL", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    rows = [("short", "Ring", 1), ("in Ring it is", "ring", 5), ("x" * 120, "Ring", 1), ("x" * 359, "Ring", None), ("x" * 360, "Ring", None), ("x" * 699, "Ring", 9), ("", "Ring", 1), ("short", None, 1)]
    assert values(spark, "a string, c string, l int", rows, A.too_generic(F.col("a"), F.col("c"), F.col("l"))) == [True, False, False, True, False, True, False, False]
    rows = [(" ok ", "VERIFIED", "en"), ("ok", "PARTIAL", "de"), ("ok", "UNKNOWN", "xx"), (None, "UNKNOWN", "en")]
    assert values(spark, "a string, m string, l string", rows, A.with_notice(F.col("a"), F.col("m"), F.col("l"))) == ["ok", "ok\n\nDies ist nicht belegt.", "ok\n\nThis is not verified.", ""]


def test_names_and_kinds(spark):
    assert values(spark, "n string, a string", [("Zed", "the hero Zed"), ("Axe", "an item"), ("Bolt", "a spell"), ("Oldburg", "went to"), ("Zed", None)], A.redaction_kind(F.col("n"), F.col("a"))) == ["character", "item", "skill", "location", "generic"]
    assert values(spark, "p string", [("3",), ("P2",), (" p3 ",), ("9",), (None,)], A.priority_weight(F.col("p"))) == [1.0, 0.6, 0.3, 0.0, 0.0]
    assert values(spark, "t string", [('say "Ana" and\ncharacters: Bo, Cy; Ana.',), ("none",), (None,)], A.listed_names(F.col("t"), "characters")) == [["Ana", "Bo", "Cy"], [], None]
    rows = [(["a", "b"], ["b"]), ([], []), (["a"], [])]
    assert values(spark, "a array<string>, b array<string>", rows, A.name_guard(F.col("a"), F.col("b"))) == ["Use only these names: a. Never use: b.", "", "Use only these names: a."]


def test_scores_of_facts(spark):
    rows = [
        (["iron wall", "gates"], ["howto"], ["iron"], "an iron wall has gate and", ["iron", "wall", "gate"], "howto", "3"),  # a phrase, a beginning, the intent, P1
        (["zzz"], [], ["iron", "gateway", "abc"], "iron gate", ["iron", "gate"], None, None),  # by tokens: one equal, one beginning
        ([], None, ["qqq"], "iron", ["iron"], "x", "3"),
    ]
    schema = "k array<string>, g array<string>, f array<string>, q string, t array<string>, n string, p string"
    got = values(spark, schema, rows, A.fact_score(F.col("k"), F.col("g"), F.col("f"), F.col("q"), F.col("t"), F.col("n"), F.col("p")))
    assert got == [2 + 2 + 1 + 1.0, 2.0, 0.0]


def test_prompts(spark):
    assert values(spark, "f array<string>", [(["a", "b"],), ([],)], A.facts_prompt(F.col("f"))) == ["Facts:\n- a\n- b", ""]
    assert values(spark, "s map<string,boolean>", [({"b": True, "a": True, "c": False},), ({},)], A.profile_prompt(F.col("s"))) == ["Systems: a, b", ""]
    assert values(spark, "a string, b string", [(" x ", "y"), ("", "y"), (None, None)], A.assemble({"a": F.col("a"), "b": F.col("b")}, ["b", "a"])) == ["y\n\nx", "y", ""]
    chosen = spark.createDataFrame([(1, "de", ["o2", "o1", "none"], " mine "), (2, "fr", ["o1"], None), (3, "en", [], None), (4, "en", None, "own")], "id int, lang string, options array<string>, custom string")
    options = spark.createDataFrame([("o1", "en", "one"), ("o1", "de", "eins"), ("o2", "en", "two")], "option string, lang string, prompt string")
    assert {r.id: r.prompt for r in A.option_prompts(chosen, options).collect()} == {1: "two\neins\nmine", 2: "one", 3: "", 4: "own"}
