"""Clusters with gates against a plain loop, in one round and in many; representatives by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import canonical as C
from factloom.plans import canonical_queries
from factloom.sources.tables import facts, table

SF = "/root/testdata/sf0.001"
_SCHEMA, _NAMES = C._columns("string")


def made(n, seed):
    """Blocks of facts around a few directions, with records of all kinds; one block null, some vectors null or zero."""
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(4, 8))
    rows = []
    for i in range(n):
        v = base[rnd.integers(4)] + rnd.normal(size=8) * 0.45
        words = lambda k, of: [f"{of}{j}" for j in rnd.choice(5, k, replace=False)]
        flags = [bool(x) for x in rnd.random(len(C.FLAGS)) < 0.5]
        vector = None if i % 41 == 7 else [0.0] * 8 if i % 41 == 8 else v.tolist()
        rows.append(([None, "a", "b"][i % 3], i, vector, words(rnd.integers(3), "s"), words(rnd.integers(3), "f"), words(rnd.integers(2), "k"), words(rnd.integers(4), "e"), *flags, int(rnd.integers(6)), ["", "x", "y", None][rnd.integers(4)]))
    return rows


def plain(rows, soft=C.SOFT, strong=C.STRONG):
    """One comparison after the other."""
    def unit(v):
        v = np.zeros(8) if v is None else np.array(v)
        return v / max(np.linalg.norm(v), 1e-12)

    def join(a, b):
        x, y = dict(zip(_NAMES, a)), dict(zip(_NAMES, b))
        sim = float(unit(x["embedding"]) @ unit(y["embedding"]))
        shares = lambda c: len(set(x[c]) & set(y[c]))
        over = lambda names: (lambda b, e: b / e if e else 0)(sum(x[f] and y[f] for f in names), sum(x[f] or y[f] for f in names))
        entity = shares("systems") > 0 or shares("families") > 0 or shares("keywords") > 0
        shape = over(["has_condition", "has_effect", "g_transition", "g_downstream", "g_chain", "g_failure_constraint"])
        union = len(set(x["entities"]) | set(y["entities"]))
        core = (0.6 * shares("entities") / union if union else 0) + 0.4 * over(["has_condition", "has_effect", "g_transition", "core_constraint", "g_downstream"])
        transition, constraint = x["g_transition"] and y["g_transition"], x["g_failure_constraint"] and y["g_failure_constraint"]
        consequence = x["has_effect"] and y["has_effect"] and any(r[f] for r in (x, y) for f in ("g_failure_constraint", "g_downstream", "g_transition", "g_chain"))
        aligned = all(r[f] for r in (x, y) for f in ("has_condition", "has_effect"))
        score = min(100, 35 * entity + 20 * transition + 20 * consequence + 20 * constraint + 15 * (shape >= 0.5) + 10 * (x["active_signals"] >= 3 and y["active_signals"] >= 3) + 10 * aligned + 20 * (core >= 0.4 - 1e-9))
        structural, anchor = consequence or transition or constraint, x["anchor"] and y["anchor"]
        guard = anchor and (score >= 65 or (shape >= 0.5 and x["structural"] and y["structural"] and structural) or core >= 0.5 - 1e-9)
        if sim < (soft - 0.12 if guard else soft):
            return "below"
        if sim < strong and (not entity or (not structural and shape < 0.5)) and not (anchor and structural and sim >= soft - 0.02):
            return "no_ground"
        return "fits"

    out, leaders = [], {}
    for row in sorted(rows, key=lambda r: r[1]):
        told = {"below": 0, "no_ground": 0, "fits": 0}
        leader = row[1]
        for other in leaders.setdefault(row[0], []):
            why = join(row, other)
            told[why] += 1
            if why == "fits":
                leader = other[1]
                break
        else:
            leaders[row[0]].append(row)
        out.append((row[1], leader, sum(told.values()), told["below"], told["no_ground"]))
    return out


@pytest.mark.parametrize(("folded", "compared", "n"), [(1000, 20000, 240), (7, 20, 240)])
def test_clusters_are_those_of_a_plain_loop(spark, folded, compared, n, monkeypatch):
    monkeypatch.setattr(C, "AT_ONCE", 30)
    rows = made(n, folded)
    got = C.gated_clusters(spark.createDataFrame(rows, _SCHEMA), "block", folded=folded, compared=compared)
    found = sorted((r.item_id, r.leader_id, r.checks, r.below_floor, r.no_ground) for r in got.collect())
    want = plain(rows)
    assert found == want and len({w[1] for w in want}) < n and any(w[4] for w in want)
    d = {r.block: r for r in C.cluster_diagnostics(got, "block").collect()}
    assert sum(r.clusters + r.merged for r in d.values()) == n and sum(r.checks for r in d.values()) == sum(w[2] for w in want)


def test_nothing_to_cluster(spark):
    assert C.gated_clusters(spark.createDataFrame([], _SCHEMA), "block").collect() == []


def test_representatives(spark):
    """Of a cluster the best and, far enough from it, the best of lowest priority; a dominant role from 7 of 10 on."""
    facts = [(1, [1.0, 0.0], 60, 40, 1, 3, "workflow"), (2, [0.0, 1.0], 50, 80, 0, 1, "workflow+operational"), (3, [1.0, 0.1], 50, 90, 0, 1, ""), (4, [1.0, 0.0], None, None, 0, 2, None), (5, [1.0, 0.0], 60, 40, 0, 3, "a"), (6, [1.0, 0.0], 60, 40, 0, 3, "b"), (7, [1.0, 0.01], 10, 99, 0, 1, "")]
    clusters = [("x", 1, 1), ("x", 2, 1), ("x", 3, 3), (None, 4, 4), ("y", 5, 5), ("y", 6, 5), ("y", 7, 5)]
    f = spark.createDataFrame(facts, "item_id long, embedding array<double>, novelty int, obviousness int, inter int, final_priority int, role_tags string")
    got = C.canonical_facts(f, spark.createDataFrame(clusters, "block string, item_id long, leader_id long"), "block")
    rows = sorted((r.leader_id, r.stands_as, r.item_id, r.cluster_size, r.dominant_role) for r in got.collect())
    assert rows == [(1, "advanced", 1, 2, "workflow"), (1, "beginner", 2, 2, "workflow"), (3, "solo", 3, 1, None), (4, "solo", 4, 1, None), (5, "advanced", 5, 3, None)]


def test_facts_of_all_documents_are_clustered(spark):
    """Every sentence of every document, not only the first of those with a vector, is in one cluster."""
    of = canonical_queries.items(spark, SF)
    n, vectors, ids = of.agg(F.count(F.lit(1)), F.count("embedding"), F.count_distinct("item_id")).first()
    assert n == facts(spark, SF).count() == ids > facts(spark, SF).where("pos = 0").count() and 0 < vectors
    docs, v = (table(spark, SF, t) for t in ("documents", "embeddings"))
    assert vectors == facts(spark, SF).join(v, F.col("doc_id") == F.col("vec_id")).count() and docs.count() > 0
    d = canonical_queries.canonical_diagnostics(spark, SF).collect()
    assert sum(r.clusters + r.merged for r in d) == n


def test_canonical_facts_stand_for_all_facts(spark):
    stands = canonical_queries.canonical_facts(spark, SF).select("label", "leader_id", "cluster_size").distinct()
    assert stands.agg(F.sum("cluster_size")).first()[0] == facts(spark, SF).count()
