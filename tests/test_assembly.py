"""Chunk merging, redaction and replacement pairs against plain versions."""

import random
import re

from pyspark.sql import functions as F

from factloom.operators import assembly, dedupe


def merged(sizes, most, cap):
    sizes = list(sizes)
    while len(sizes) > most:
        sums = [a + b for a, b in zip(sizes, sizes[1:])]
        if min(sums) > cap:
            break
        i = sums.index(min(sums))
        sizes[i:i + 2] = [sums[i]]
    return sizes


def test_merge_cheapest(spark):
    rnd = random.Random(5)
    cases = [None, [], [7], [600] * 14, [1] * 40] + [[rnd.randint(1, 700) for _ in range(rnd.randint(0, 30))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, s array<bigint>").select("i", assembly.merge_cheapest(F.col("s"), 6, 1500).alias("m"))
    assert {r.i: r.m for r in df.collect()} == {i: None if c is None else merged(c, 6, 1500) for i, c in enumerate(cases)}


def test_redact(spark):
    rows = [("Hello Maria, and Peter.", ["Maria"]), ("Maria Mariana", ["Maria", "Absent"]), ("", ["Maria"]), (None, ["Maria"]), ("a  Peter", []), ("Ana Élise and Élise", ["Élise", "Ana Élise"]), ("a (b. c", ["(b."])]
    got = [r.t for r in spark.createDataFrame(rows, "t string, o array<string>").select(assembly.redact(F.col("t"), F.col("o")).alias("t")).collect()]
    assert got == ["Hello [name], and Peter.", "[name] Mariana", "", None, "a  Peter", "[name] and [name]", "a [name] c"]


def test_names(spark):
    text = "Anna met Peter Müller and O'Brien; Élise saw R2-D2 XY, PETER \u0130pek"
    got = spark.createDataFrame([(text,)], "t string").select(assembly.names("t").alias("n")).first().n
    assert got == ["Anna", "Peter Müller", "O'Brien", "Élise", "R2-D2", "PETER \u0130pek"]


def test_link_score(spark):
    sets = {"title": ["iron", "wall"], "heading": ["iron"], "subheading": [], "path": ["guide"], "lexicon": []}
    rows = [("iron wall guide", "/x/iron", 5), ("go", "#", 0), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, u string, d int")
    lists = {n: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for n, v in sets.items()}
    got = [r.s for r in df.select(assembly.link_score(F.coalesce("t", F.lit("")), F.coalesce("u", F.lit("")), lists, F.coalesce("d", F.lit(0))).alias("s")).collect()]
    # each of two title tokens, one heading and one path token; a long text of several tokens; a density of 5 / 80
    assert got == [min(100, 2 * 30 + 25 + 15 + 5 + 5 + 6), 0, 0]


def test_rare_token_pairs(spark):
    rnd = random.Random(3)
    sets = {k: sorted({f"t{min(rnd.randint(0, 12), rnd.randint(0, 12))}" for _ in range(rnd.randint(1, 7))}) for k in range(60)}
    a, b = (spark.createDataFrame([(k, v) for k, v in sets.items() if k % 2 == p], "id int, tokens array<string>") for p in (0, 1))
    got = {(r.left_id, r.right_id) for r in dedupe.rare_token_pairs(a, b, .5).collect()}
    like = lambda x, y: 2 * len(set(x) & set(y)) >= len(set(x) | set(y))
    assert got == {(i, j) for i in sets for j in sets if i % 2 == 0 and j % 2 == 1 and like(sets[i], sets[j])}
