"""The way of a dropped, a merged and a demoted fact; the cap against a plain sort."""

import random

import pytest

from factloom.operators import lineage as L

SCHEMA = "doc_id long, pos int, source string, fact string, drop_reason string, layer string, novelty int, obviousness int, final_priority int, score_a int, inter int, shape string, n_systems int, t_resource boolean, guard boolean"


def row(doc, pos, fact, source="s", drop=None, priority=2, score=0, shape="", novelty=50):
    return (doc, pos, source, fact, drop, "A", novelty, 50, priority, score, 0, shape, 0, False, False)


def test_ways(spark):
    rows = [row(1, 0, "Gone", drop="low-signal"), row(1, 1, "Twice"), row(2, 0, "twice"), row(3, 0, "a", priority=3, score=9), row(3, 1, "b", priority=3, score=8), row(9, 0, None, drop="missing-text")]
    rows += [row(4, k, f"shaped {k}", shape="requires_x", priority=2) for k in range(9)]
    got = {(r.doc_id, r.pos): r for r in L.normalize_raw(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert got[1, 0].stages == "filter: low-signal" and got[1, 0].status == "dropped" and got[1, 0].priority is None
    assert (got[1, 1].status, got[1, 1].merged, got[1, 1].stages) == ("final", 2, "filter: passed > merge: first of 2 > score: 2 > shape: kept 2 > layer: A")
    assert (got[2, 0].status, got[2, 0].into_doc, got[2, 0].into_pos, got[2, 0].stages) == ("merged", 1, 1, "filter: passed > merge: into 1/1")
    # six of nine are too many: 50 + 12 obviousness, so priority stays at 2 at most
    assert all(got[4, k].scored == 2 and got[4, k].demoted is None for k in range(9))
    assert got[3, 0].priority == 3 and got[3, 1].priority == 3  # two of twelve are no more than a fifth
    assert got[9, 0].status == "dropped" and len({r.id for r in got.values()}) == len(rows)


def test_repetition_demotes(spark):
    rows = [row(1, k, f"fact {k}", shape="requires_x", priority=2, source=None) for k in range(16)]  # 13 too many: 76 obviousness
    got = L.normalize_raw(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.scored, r.shaped, r.priority, r.demoted) for r in got} == {(2, 1, 1, "repetition")}


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_cap_keeps_the_first_of_equals(spark, monkeypatch, bits):
    monkeypatch.setattr(L, "_DOCS_BITS", bits)
    rnd = random.Random(bits)
    rows = [row(d, p, f"{s} {d} {p}", source=s, priority=rnd.choice([2, 3, 3]), score=rnd.choice([5, 5, 5, 6])) for s in ("x", "y") for d in range(12) for p in range(2 + (s == "y"))]
    rows = [(r[0] + 100 * (r[2] == "y"), *r[1:]) for r in rows]
    got = {(r.doc_id, r.pos): r.priority for r in L.normalize_raw(spark.createDataFrame(rows, SCHEMA)).collect()}
    for s in ("x", "y"):
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (r[8] != 3, -r[9], r[0], r[1]))
        top = sum(r[8] == 3 for r in own)
        stay = -(-len(own) * 15 // 100) if top > -(-len(own) // 5) else top
        assert [got[r[0], r[1]] for r in own] == [3 if r[8] == 3 and i < stay else 2 for i, r in enumerate(own)]


def test_no_facts(spark):
    assert L.normalize_raw(spark.createDataFrame([], SCHEMA)).collect() == []
