"""Cohesion of chunks, quoted names and intents against plain loops and cases by hand."""

from collections import Counter

from pyspark.sql import functions as F

from factloom.operators import cohesion as C

SCHEMA = "doc_id long, families array<string>, systems array<string>, keywords array<string>"


def test_cohesion_equals_a_plain_loop(spark):
    rows = [
        (1, ["logi", "logi", ""], ["a", "b"], ["x", "y"]), (1, ["logi"], None, ["z", "x"]), (1, ["rare"], ["a"], ["q"]), (1, ["fail"], ["a"], []), (1, None, [], ["w", None]), (1, [], [], ["x", "y", "z"]),
        (2, [], [], []), (3, None, None, None), (3, ["b"], ["s"], ["k"]), (3, ["b"], ["s"], ["k"]), (None, ["logi"], ["a"], ["x"]),
    ]
    got = {r.doc_id: r for r in C.chunk_cohesion(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3}
    for doc, r in got.items():
        own = [[{x for x in (c or []) if x} for c in row[1:]] for row in rows if row[0] == doc]
        counts = [Counter(x for f in own for x in f[k]) for k in range(3)]
        top = [[e for e, _ in sorted(counts[k].items(), key=lambda e: (-e[1], e[0]))][:n] for k, n in ((0, 2), (2, 3))]
        stray = sum(not f[0] & set(top[0]) and not f[2] & set(top[1]) for f in own)
        assert (r.facts, r.stray, r.multi_system) == (len(own), stray, sum(len(f[1]) > 1 for f in own))
        assert (r.n_families, r.n_systems, r.n_keywords) == tuple(map(len, counts)) and [r.top_families or [], r.top_keywords or []] == top
        assert r.drift == (stray * 2000 + len(own)) // (2 * len(own))
    empty = C.chunk_cohesion(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    assert tuple(C.cohesion_summary(empty).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_quoted_names_and_what_denies_them(spark):
    cases = {
        'The smith is "Aldo Rey" and his friend is "Mara".': [("Aldo Rey", False), ("Mara", False)],
        'There is no character called "Zed", but "Mara" exists.': [("Zed", True), ("Mara", False)],
        'She was never "Ann" or "Bea"; "Cleo" is right.': [("Ann", True), ("Bea", True), ("Cleo", False)],
        'Der Name ist nicht "Otto", sondern "Karl".': [("Otto", True), ("Karl", False)],
        "Es gibt keine 'Lena' ohne \"Jan\". 'Ute' lebt.": [("Lena", True), ("Jan", True), ("Ute", False)],
        "It's Tom's \"Axe\", nothing is knotted.": [("Axe", False)],
        'no "' + "a" * 61 + '" here': [], 'no "  " here': [], 'not "x" and "y"': [("and", True)],
        'no "But Not Really" here': [("But Not Really", True)],
        "": [], None: [],
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string")
    got = {r.i: [tuple(x) for x in r.q] for r in docs.select("i", C.quoted_names(F.col("text")).alias("q")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_a_name_denied_once_is_forbidden_in_its_group(spark):
    rows = [("a", '"Mara" is here.'), ("a", 'There is no "Mara".'), ("a", '"Jo" is here. "Jo" stays.'), ("b", '"Mara" is here.'), (None, '"Mara" left.'), ("b", None)]
    got = {(r.g, r.name): (r.said, r.denied, r.name_set) for r in C.name_sets(spark.createDataFrame(rows, "g string, text string"), ["g"]).collect()}
    assert got == {("a", "Mara"): (1, 1, "forbidden"), ("a", "Jo"): (2, 0, "verified"), ("b", "Mara"): (1, 0, "verified"), (None, "Mara"): (1, 0, "verified")}


def test_intents_by_priority_then_order_of_patterns(spark):
    rules = [("late", 9, ["how to", "go"]), ("first", 1, ["how do", "up"]), ("mid", 5, ["how to", " "])]
    cases = {"how to go up": ("first", "up"), "how to go": ("mid", "how to"), "going upward": ("unknown", None), "somehow to": ("mid", "how to"), "go": ("late", "go"), "": ("unknown", None)}
    docs = spark.createDataFrame(list(enumerate(cases)), "i int, key string")
    got = {r.i: (r.x.intent, r.x.matched_by) for r in docs.select("i", C.intent_of(F.col("key"), rules).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
