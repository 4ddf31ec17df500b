"""Operators whose result depends on an order, against plain loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import context, dedupe
from factloom.plans import fact_queries, table_queries
from factloom.sources.tables import facts, table

SF = "/root/testdata/sf0.001"


def plain_clusters(rows, soft):
    out = {}
    leaders = {}
    for label, vec_id, v in sorted(rows, key=lambda r: r[1]):
        x = np.zeros(64) if v is None else np.array(v, float) / max(np.linalg.norm(v), 1e-12)
        own = leaders.setdefault(label, [])
        hit = next((i for i, y in own if x @ y >= soft), None)
        if hit is None:
            own.append((vec_id, x))
        out[vec_id] = vec_id if hit is None else hit
    return out


@pytest.mark.parametrize(("folded", "compared", "soft"), [(1000, 20_000, .74), (7, 20, .74), (5, 11, .2)])
def test_leader_clusters(spark, folded, compared, soft):
    rows = [(r.label if r.vec_id % 2 else 1, r.vec_id, list(map(float, r.embedding))) for r in table(spark, SF, "embeddings").collect()]
    rows += [(None, 100_000, rows[0][2]), (None, 100_001, rows[0][2]), (1, 100_002, None), (1, 100_003, None), (1, 100_004, [0.0] * 64)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>")
    got = {r.vec_id: r.leader_id for r in dedupe.leader_clusters(df, soft, folded=folded, compared=compared).collect()}
    assert got == plain_clusters(rows, soft)
    assert dedupe.leader_clusters(df.limit(0)).collect() == []


def test_context_states(spark):
    events = table(spark, SF, "events").withColumn("name", F.when(F.col("event_type") != "error", F.col("event_type"))).withColumn("user_id", F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 3))
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "name").collect()
    want, states = {}, {}
    for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
        states[r.user_id] = context.step(states.get(r.user_id, context.START), r.name, r.us / 1e6)
        want[r.event_id] = states[r.user_id][0]
    assert {r.event_id: r.context for r in context.context_states(events).collect()} == want
    assert context.context_states(events.limit(0)).collect() == []


def words_of(text, least):
    return {w for w in re.sub("[^a-z0-9]+", " ", text.lower()).split() if len(w) >= least}


def test_near_duplicate_marks(spark):
    want, kept = {}, defaultdict(list)
    for r in sorted(facts(spark, SF).where("fact <> ''").select("doc_id", "pos", "fact").collect(), key=lambda r: (r.doc_id, r.pos)):
        own = words_of(r.fact, 3)
        like = next((p for p, t in kept[r.doc_id] if min(len(own), len(t)) >= 8 and len(own & t) >= max(6, .93 * len(own | t))), None)
        want[r.doc_id, r.pos] = like
        if like is None:
            kept[r.doc_id].append((r.pos, own))
    got = {(r.doc_id, r.pos): r.like_pos for r in fact_queries.near_duplicate_marks(spark, SF).collect()}
    assert got == want
    rows = [(1, k, t) for k, t in enumerate(["one two three four", "one two three four", "aa1 bb1 cc1 dd1 ee1 ff1 gg1 hh1 ii1", "aa1 bb1 cc1 dd1 ee1 ff1 gg1 hh1 ii1"])]
    marked = dedupe.mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, pos int, fact string")).orderBy("pos").collect()
    assert [r.like_pos for r in marked] == [None, None, None, 2] and [r.kept for r in marked] == [True, True, True, False]


def test_document_chunks(spark):
    want = []
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        sizes = [0]
        for s in re.split(r"(?<=[.!?])\s+", r.text, flags=re.ASCII):
            n = -(-len(s) // 4)
            if sizes[-1] and sizes[-1] + n > 500:
                sizes.append(0)
            sizes[-1] += n
        want += [(r.doc_id, k + 1, n) for k, n in enumerate(sizes)]
    assert sorted((r.doc_id, r.chunk_id, r.tokens) for r in table_queries.document_chunks(spark, SF).collect()) == sorted(want)


def test_equivalence_best_match(spark):
    runs = [{r.key for r in d.select("key").collect()} for d in table_queries._runs(spark, SF)]
    left, right = ({k: t for k in one - two if len(t := words_of(k, 4)) >= 2} for one, two in (runs, runs[::-1]))
    having = defaultdict(list)
    for k, t in right.items():
        for w in t:
            having[w].append(k)
    want = {}
    for k, t in left.items():
        shared = Counter(o for w in t for o in having[w])
        best = min(((-n / (u := len(t) + len(right[o]) - n), o, n, u) for o, n in shared.items() if n >= .5 * (len(t) + len(right[o]) - n)), default=None)
        if best:
            want[k] = best[1:]
    got = {r.left_id: (r.right_id, r.shared, r.union_size) for r in table_queries.equivalence_best_match(spark, SF).collect()}
    assert want and got == want
