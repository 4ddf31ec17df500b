"""Canonical facts: first-fit clusters whose acceptance depends on vectors and on records, and their representatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.dedupe import COMPARED, FOLDED, _units
from factloom.sources.tables import discard, written

# From which cosine a fact may join, from which it needs no common ground, how much a guard lowers the
# first, how much a common anchor does; and what common ground adds to the mechanic score, in hundredths.
SOFT, STRONG, GUARD, ANCHORED = 0.74, 0.86, 0.12, 0.02
POINTS = {"entity": 35, "transition": 20, "consequence": 20, "constraint": 20, "shape": 15, "strength": 10, "aligned": 10, "core": 20}

FLAGS = ["anchor", "g_transition", "g_failure_constraint", "g_downstream", "g_chain", "has_condition", "has_effect", "structural", "core_constraint", "t_advice"]
LISTS = ["systems", "families", "keywords", "entities"]
_SHAPE, _CORE = ["has_condition", "has_effect", "g_transition", "g_downstream", "g_chain", "g_failure_constraint"], ["has_condition", "has_effect", "g_transition", "core_constraint", "g_downstream"]
_MOVES = ["g_failure_constraint", "g_downstream", "g_transition", "g_chain"]
#: Rows that are compared with all leaders at once.
AT_ONCE = 500
#: A round looks for leaders in so many times `folded` facts of the largest block.
SCANNED = 20


def _shared(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """How many entries each list of a shares with each of b, and how many either has."""
    at: dict[str, int] = {}

    def table(lists) -> np.ndarray:
        rows = [{at.setdefault(v, len(at)) for v in (x if x is not None else [])} for x in lists]
        return rows

    left, right = table(a), table(b)
    width = max(1, len(at))

    def spread(rows) -> np.ndarray:
        out = np.zeros((len(rows), width), np.float32)
        for i, row in enumerate(rows):
            out[i, list(row)] = 1
        return out

    x, y = spread(left), spread(right)
    both = x @ y.T
    return both, x.sum(1)[:, None] + y.sum(1)[None, :] - both


def compare(a: pd.DataFrame, b: pd.DataFrame, width: int, soft: float = SOFT, strong: float = STRONG) -> dict[str, np.ndarray]:
    """Every row of a with every row of b: cosine, common ground, and whether the similarity and the gates let a join."""
    sim = _units(a["embedding"], width) @ _units(b["embedding"], width).T
    x, y = ({f: df[f].fillna(False).to_numpy(bool) for f in FLAGS} for df in (a, b))
    both = lambda f: x[f][:, None] & y[f][None, :]
    either = lambda f: x[f][:, None] | y[f][None, :]
    ratio = lambda names: (sum(both(f).astype(int) for f in names), sum(either(f).astype(int) for f in names))
    share = lambda n, of: np.where(of > 0, n / np.maximum(of, 1), 0.0)
    lists = {c: _shared(a[c], b[c]) for c in LISTS}
    entity = (lists["systems"][0] > 0) | (lists["families"][0] > 0) | (lists["keywords"][0] > 0)
    shape, core = share(*ratio(_SHAPE)), 0.6 * share(*lists["entities"]) + 0.4 * share(*ratio(_CORE))
    anchor, transition, constraint, aligned = both("anchor"), both("g_transition"), both("g_failure_constraint"), both("has_condition") & both("has_effect")
    consequence = both("has_effect") & np.logical_or.reduce([either(f) for f in _MOVES])
    strength = (a["active_signals"].to_numpy() >= 3)[:, None] & (b["active_signals"].to_numpy() >= 3)[None, :]
    core_near = core >= 0.4 - 1e-9
    score = sum(POINTS[n] * on.astype(int) for n, on in (("entity", entity), ("transition", transition), ("consequence", consequence), ("constraint", constraint), ("shape", shape >= 0.5), ("strength", strength), ("aligned", aligned), ("core", core_near)))
    score = np.minimum(100, score)
    structural = consequence | transition | constraint
    guard = anchor & ((score >= 65) | ((shape >= 0.5) & both("structural") & structural) | (core >= 0.5 - 1e-9))
    near = sim >= np.where(guard, soft - GUARD, soft)
    fits = near & ((sim >= strong) | (entity & (structural | (shape >= 0.5))) | (anchor & structural & (sim >= soft - ANCHORED)))
    return {"similarity": sim, "near": near, "fits": fits, "guard": guard, "core": core, "core_near": core_near, "transition": transition, "consequence": consequence, "score": score, "bare": (sim >= strong) & ~entity, "voice": either("t_advice")}


def _columns(block_type: str) -> tuple[str, list[str]]:
    lists = ", ".join(f"{c} array<string>" for c in LISTS)
    flags = ", ".join(f"{c} boolean" for c in FLAGS)
    return f"block {block_type}, item_id long, embedding array<double>, {lists}, {flags}, active_signals int, representation string", ["block", "item_id", "embedding", *LISTS, *FLAGS, "active_signals", "representation"]


_TOLD = ["checks", "below_floor", "no_ground"]
_MERGE = "leader_id long, similarity double, mechanic_score int, core_overlap double, core_merge boolean, guard_merge boolean, transition_merge boolean, consequence_merge boolean, bare_merge boolean, voice_merge boolean, drift boolean"


def gated_clusters(items: DataFrame, block: str, soft: float = SOFT, strong: float = STRONG, folded: int = FOLDED, compared: int = COMPARED) -> DataFrame:
    """First fit within each block, in the order of item_id: a fact joins the first cluster whose leader it is near
    enough to and has common ground with, else it leads one of its own.

    items: block, item_id, embedding, the lists systems, families, keywords and entities, the FLAGS, active_signals and
    representation.  Near enough is a cosine of `soft`, less where both are anchored and alike in their mechanics (the
    guard); common ground is an entity along with alike structure, or anchors and structure; from `strong` on none is
    needed.  Rounds: the first facts of a block without a cluster are folded in order in one task, until there are
    `folded` leaders or so, then all that are left, dealt over tasks of about `compared`, meet the new leaders in order,
    which is the first fit, as leaders of later rounds come later.  What each fact was refused by before is added up over
    the rounds.  Tables of a round are deleted once the next one stands on its own.  Facts without a vector lead
    clusters of their own and take no part in the rounds; they are counted in their order.

    Returns block, item_id, leader_id, similarity, how alike they are, and checks, below_floor and no_ground: the
    leaders it was compared with, and those that refused it for either reason.  A null embedding is near nothing, what
    is told of its likeness but `similarity` is null, and
    a null list or flag is empty or false; a null block is a block; no facts give no rows.
    """
    width = items.agg(F.max(F.size("embedding"))).first()[0] or 1
    width = max(1, width)
    kind = dict(items.dtypes)[block]
    schema, names = _columns(kind)
    start = items.select(F.col(block).alias("block"), F.col("item_id").cast("long").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"), *LISTS, *FLAGS, F.coalesce("active_signals", F.lit(0)).cast("int").alias("active_signals"), "representation")
    start = written(start.select(*names, *[F.lit(0).cast("long").alias(c) for c in _TOLD]), "items-to-cluster")
    alone, left = start.where("embedding IS NULL"), start.where("embedding IS NOT NULL")

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id", kind="stable")
        leaders = pdf.iloc[:0]
        for i in range(0, len(pdf), AT_ONCE):
            part = pdf.iloc[i:i + AT_ONCE]
            if len(leaders):
                part = part[~compare(part, leaders, width, soft, strong)["fits"].any(axis=1)]
            fits, new = compare(part, part, width, soft, strong)["fits"], []
            for k in range(len(part)):
                if not fits[k, new].any():
                    new.append(k)
            leaders = pd.concat([leaders, part.iloc[new]])
            if len(leaders) >= folded:
                break
        return leaders[names]

    def join(rows: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values("item_id", kind="stable")
        ids, out = leaders["item_id"].to_numpy(), []
        for i in range(0, len(rows), AT_ONCE):
            part = rows.iloc[i:i + AT_ONCE]
            of = compare(part, leaders, width, soft, strong)
            own = part["item_id"].to_numpy()[:, None] == ids[None, :]
            fits = of["fits"] | own
            found, at, each = fits.any(axis=1), fits.argmax(axis=1), np.arange(len(part))
            before = np.arange(len(ids))[None, :] < np.where(found, at, len(ids))[:, None]
            below, refused = (before & ~of["near"]).sum(1), before.sum(1)
            leads = own[each, at]
            pick = lambda name: of[name][each, at]
            said = leaders["representation"].to_numpy()[at]
            new = {
                "leader_id": pd.array(np.where(found, ids[at], 0), dtype="Int64"), "similarity": np.where(leads, 1.0, pick("similarity")), "mechanic_score": pick("score"), "core_overlap": pick("core"), "core_merge": pick("core_near"), "guard_merge": pick("guard"),
                "transition_merge": pick("transition"), "consequence_merge": pick("consequence"), "bare_merge": pick("bare"), "voice_merge": pick("voice"), "drift": [bool(p and q and p != q) for p, q in zip(part["representation"], said)],
            }
            new["leader_id"][~found] = pd.NA
            part = part.assign(**new)
            part["checks"] += refused + (found & ~leads)
            part["below_floor"] += below
            part["no_ground"] += refused - below
            out.append(part)
        return pd.concat(out)[[*names, *_TOLD, *[c.split()[0] for c in _MERGE.split(", ")]]]

    done = None
    while True:
        largest = left.groupBy("block").count().agg(F.max("count")).first()[0] or 1
        # any first facts in order will do, so the last of them need not be an exact rank
        last = left.groupBy(F.col("block").alias("of")).agg(F.percentile_approx("item_id", min(1.0, SCANNED * folded / largest)).alias("last"))
        first = left.join(last, F.col("block").eqNullSafe(F.col("of"))).where("item_id <= last").select(*names)
        leaders = written(first.groupBy("block").applyInPandas(lead, schema), "leaders")
        parts = left.groupBy(F.col("block").alias("of")).agg(F.ceil(F.count(F.lit(1)) / compared).cast("int").alias("parts"))
        same = F.col("block").eqNullSafe(F.col("of"))
        dealt = left.join(parts, same).withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")).drop("of", "parts")
        each = leaders.join(parts, same).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("of", "parts")
        told = ", ".join(f"{c} long" for c in _TOLD)
        met = dealt.groupBy("block", "part").cogroup(each.groupBy("block", "part")).applyInPandas(join, f"{schema}, {told}, {_MERGE}")
        met = written(met, "clustered")
        have = met.where("leader_id IS NOT NULL").select(F.col("block").alias(block), "item_id", *[c.split()[0] for c in _MERGE.split(", ")], *_TOLD)
        done = have if done is None else done.unionByName(have)
        before, left = left, written(met.where("leader_id IS NULL").select(*names, *_TOLD), "to-cluster")
        discard(before, leaders)
        if left.isEmpty():
            discard(left)
            return done if alone.isEmpty() else _with_those_alone(done, alone, block)


def _with_those_alone(clusters: DataFrame, alone: DataFrame, block: str) -> DataFrame:
    """clusters and the facts alone, each of which leads itself and is refused by all leaders before it, as it refuses
    all facts that go past it: those are counted from ranges of each block and a row for each of these."""
    heads = clusters.where("leader_id = item_id").select(F.col(block).alias("block"), "item_id", F.lit(0).alias("alone"))
    heads = heads.unionByName(alone.select("block", "item_id", F.lit(1).alias("alone"))).repartitionByRange("block", "item_id")
    heads = written(heads.withColumn("part", F.spark_partition_id()), "leading")
    runs = heads.groupBy(F.col("block").alias("of"), F.col("part").alias("range")).agg(F.count(F.lit(1)).alias("n"), F.sum("alone").alias("m"))
    w = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("of", "range", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("n", "m")])
    w = Window.partitionBy("part", "block").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.join(runs, (F.col("part") == F.col("range")) & F.col("block").eqNullSafe(F.col("of")))
    before = lambda n, c: (F.col(n) + F.coalesce(F.sum(c).over(w), F.lit(0))).cast("long")
    heads = written(heads.select("block", F.col("item_id").alias("head"), "alone", before("n", F.lit(1)).alias("leaders"), before("m", "alone").alias("passed")), "leading-in-order")
    told = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _MERGE.split(", ")} | {"leader_id": F.col("head"), "similarity": F.lit(1.0), "checks": F.col("leaders"), "below_floor": F.col("leaders"), "no_ground": F.lit(0).cast("long")}
    own = heads.where("alone = 1").select(F.col("block").alias(block), F.col("head").alias("item_id"), *[v.alias(c) for c, v in told.items()])
    of = heads.where("alone = 0").select(F.col("block").alias("_block"), "head", "passed")
    met = clusters.join(of, F.col(block).eqNullSafe(F.col("_block")) & (F.col("leader_id") == F.col("head")))
    met = met.select(*[(F.col(c) + F.col("passed")).alias(c) if c in ("checks", "below_floor") else clusters[c] for c in clusters.columns])
    return met.unionByName(own)


def cluster_diagnostics(clusters: DataFrame, block: str) -> DataFrame:
    """What the clustering of each block did: clusters, merges and their kinds, comparisons and why they failed."""
    merged = F.col("leader_id") != F.col("item_id")
    share = lambda c: F.round(F.coalesce(F.count_if(merged & F.col(c)) / F.nullif(F.count_if(merged), F.lit(0)), F.lit(0.0)), 3).alias(f"{c}_share")
    mean = lambda c, name: F.round(F.coalesce(F.sum(F.when(merged, c)) / F.nullif(F.count_if(merged), F.lit(0)), F.lit(0.0)), 3).alias(name)
    return clusters.groupBy(block).agg(
        F.count_if(~merged).alias("clusters"), F.count_if(merged).alias("merged"), F.sum("checks").alias("checks"), F.sum("below_floor").alias("below_floor"), F.sum("no_ground").alias("no_ground"), F.count_if(merged & F.col("bare_merge")).alias("bare_merges"),
        F.round(F.coalesce(F.count_if(merged) / F.nullif(F.sum("checks"), F.lit(0)), F.lit(0.0)), 3).alias("merge_rate"), *[share(c) for c in ("core_merge", "guard_merge", "transition_merge", "consequence_merge", "voice_merge", "drift")],
        F.round(F.coalesce(F.count_if(merged & F.col("guard_merge") & (F.col("similarity") < SOFT)) / F.nullif(F.count_if(merged), F.lit(0)), F.lit(0.0)), 3).alias("low_similarity_share"),
        mean(F.col("core_overlap"), "mean_core_overlap"), mean(F.col("similarity") - F.col("mechanic_score") / 100, "wording_over_mechanic"),
    )


def _cosine(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(F.transform(a, lambda v: v * v))) * F.sqrt(total(F.transform(b, lambda v: v * v)))
    return F.when(norms > 0, total(F.zip_with(a, b, lambda x, y: x * y)) / norms).otherwise(0.0)


def canonical_facts(facts: DataFrame, clusters: DataFrame, block: str, strong: float = STRONG) -> DataFrame:
    """The facts that stand for their clusters, with the cluster, its size and the role that at least seven tenths of
    its facts with roles have.

    A cluster of one stands for itself.  Else the fact that scores best as advanced does, the first of equals, and
    beside it the best of the lowest priority as one for beginners, unless it is that fact or as near to it as `strong`.
    facts: item_id, embedding, novelty, obviousness, inter, final_priority, role_tags; partial results are formed
    before the shuffle, so a cluster of any size costs a row a task.
    """
    novelty, obvious, priority = F.coalesce("novelty", F.lit(50)), F.coalesce("obviousness", F.lit(50)), F.coalesce("final_priority", F.lit(2))
    advanced, beginner = 60 * priority + novelty - obvious + F.least(F.lit(40), 10 * F.col("inter")), 200 * (3 - priority) + 2 * obvious - novelty
    rows = clusters.select(block, "item_id", "leader_id").join(facts.select("item_id", F.col("embedding").cast("array<double>").alias("embedding"), advanced.alias("_a"), beginner.alias("_b"), priority.alias("_p"), F.filter(F.split(F.coalesce("role_tags", F.lit("")), "[+]"), lambda r: r != "").alias("_roles")), "item_id")
    best = lambda score: F.struct((-F.col(score)).alias("s"), F.col("item_id").alias("id"), F.col("embedding").alias("e"))
    heads = rows.groupBy(block, "leader_id").agg(F.count(F.lit(1)).alias("size"), F.min(best("_a")).alias("a"), F.min(F.when(F.col("_p") == 1, best("_b"))).alias("b"), F.count_if(F.size("_roles") > 0).alias("bearing"))
    roles = rows.select(block, "leader_id", F.explode("_roles").alias("role")).groupBy(block, "leader_id", "role").agg(F.count(F.lit(1)).alias("n"))
    roles = roles.groupBy(F.col(block).alias("_block"), F.col("leader_id").alias("_leader")).agg(F.min(F.struct((-F.col("n")).alias("m"), "role")).alias("r"))
    heads = heads.join(roles, F.col(block).eqNullSafe(F.col("_block")) & (F.col("leader_id") == F.col("_leader")), "left")
    dominant = F.when(-F.col("r.m") * 10 >= F.col("bearing") * 7, F.col("r.role"))
    second = (F.col("size") > 1) & F.col("b").isNotNull() & (F.col("b.id") != F.col("a.id")) & (_cosine(F.col("a.e"), F.col("b.e")) < strong)
    stands = F.array(F.struct(F.col("a.id").alias("item_id"), F.when(F.col("size") == 1, "solo").otherwise("advanced").alias("stands_as")), F.when(second, F.struct(F.col("b.id").alias("item_id"), F.lit("beginner").alias("stands_as"))))
    return heads.select(block, "leader_id", F.col("size").alias("cluster_size"), dominant.alias("dominant_role"), F.explode(F.array_compact(stands)).alias("s")).select(block, "leader_id", "cluster_size", "dominant_role", "s.item_id", "s.stands_as")
