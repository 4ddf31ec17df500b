"""The best partner of a token set, against a plain loop; candidates are confirmed where they are met."""

import os
import pathlib
import random
import re
from urllib.parse import urlparse

from pyspark.sql import functions as F

from factloom.operators import dedupe
from factloom.sources import tables


def test_best_matches(spark):
    rnd = random.Random(11)
    # frequent words, sets of one word, equal sets under several ids, equal shares that the id decides, an empty set
    sets = lambda p: {f"{p}{k:03}": rnd.sample("abcdefgh", rnd.choice([1, 1, 2, 3, 4, 6])) + rnd.sample(["x", "y", f"{p}{k}"], rnd.randrange(3)) for k in range(120)} | {f"{p}-": []}
    a, b = sets("l"), sets("r")
    left, right = (spark.createDataFrame(list(x.items()), "id string, tokens array<string>") for x in (a, b))
    for least in (.5, .8):
        want = {}
        for i, x in a.items():
            like = [(-len({*x} & {*y}) / len({*x} | {*y}), j, len({*x} & {*y}), len({*x} | {*y})) for j, y in b.items() if x and y and len({*x} & {*y}) >= least * len({*x} | {*y})]
            if like:
                want[i] = min(like)[1:]
        got = dedupe.best_matches(left, right, least).collect()
        assert {r.left_id: (r.right_id, r.shared, r.union_size) for r in got} == want and len(got) == len(want)
        assert any(w[1] < w[2] for w in want.values())


def test_candidates_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "FEW", 0)
    side = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "id long, tokens array<string>")
    pairs = dedupe.rare_token_pairs(side, side, .5)
    # what is dealt out by both ids has been confirmed: candidates grew with the square of the sets and filled the disks
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" in plan[re.search(r"hashpartitioning\(left_\w+#\d+L?, right_", plan).end():]
    assert {tuple(r) for r in pairs.collect()} == {(1, 1, 2, 2), (2, 2, 2, 2)}
    assert dedupe.best_matches(side.limit(0), side, .5).isEmpty() and dedupe.best_matches(side, side.limit(0), .5).isEmpty()


def _shuffled(folder):
    return sum(f.stat().st_size for f in folder.rglob("shuffle_*.data") if f.exists())


def test_best_matches_in_parts(spark, monkeypatch):
    """The same matches where prefixes meet and tokens are numbered part by part, each with a smaller shuffle; the tables
    on the way are deleted."""
    rnd = random.Random(3)
    a, b = ([(f"{p}{k}", rnd.sample("abcdefghijklmno", rnd.randrange(1, 9))) for k in range(200)] for p in "lr")
    left, right = (spark.createDataFrame(x, "id string, tokens array<string>") for x in (a, b))
    want = {tuple(r) for r in dedupe.best_matches(left, right, .5).collect()}
    monkeypatch.setattr(dedupe, "PART_NUMBERS", 500)
    monkeypatch.setattr(dedupe, "NUMBERED_SETS", 50)
    for sent in (0, 100):
        monkeypatch.setattr(dedupe, "SENT_TOKENS", sent)
        made = []
        monkeypatch.setattr(dedupe, "written", lambda df, what: (made.append(what), tables.written(df, what))[1])
        source = tables.written(left, "source")
        at = os.path.dirname(urlparse(source.inputFiles()[0]).path)
        got = dedupe.best_matches(source, right, .5, source)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 100
        assert made.count("best-of-part") > 2 and made.count("set-numbers") > 4
        kept = {os.path.basename(os.path.dirname(f)) for f in got.inputFiles()}
        assert all(x.startswith("best-matches") for x in kept) and not os.path.exists(at)


def test_what_was_shuffled_for_a_table_is_deleted(spark):
    """It stayed until the driver collected its garbage, and filled the disks."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [pathlib.Path(str(d)) for d in env.blockManager().diskBlockManager().localDirs()]
    before = sum(_shuffled(d) for d in folders)
    t = tables.written(spark.range(200_000).groupBy((F.col("id") % 150_000).alias("k")).count(), "grouped")
    assert sum(_shuffled(d) for d in folders) <= before
    assert t.count() == 150_000 and spark.conf.get(tables.CLEANUP) == "false"
