"""A Merkle manifest of a dataset whose levels are pivots: each run of children stands in the columns of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise, numbered

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "array<struct<left:string,right:string>>"


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 over the columns: `-` for null, else the value's UTF-8 bytes counted, `:`, the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def ascii_lower(text: str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _slots(prefix: str = "c") -> list[str]:
    return [f"{prefix}{k}" for k in range(FANOUT)]


def _pivot(nodes: DataFrame, digest: str, carry: str | None = None) -> DataFrame:
    """A row for each run of FANOUT nodes: its place among the runs, the nodes' digests in c0.. and what they carry
    in r0..; _n stays the number of nodes of the group."""
    slot = F.col("_pos") % FANOUT
    spread = [F.max(F.when(slot == k, F.col(digest))).alias(c) for k, c in enumerate(_slots())]
    if carry:
        spread += [F.max(F.when(slot == k, F.col(carry))).alias(c) for k, c in enumerate(_slots("r"))]
    return nodes.groupBy("_g", F.floor(F.col("_pos") / FANOUT).alias("_run"), "_n").agg(*spread)


def _digest() -> Column:
    """Of a run: the hash of its slots one after another; a group's only node stays as it is."""
    return F.when(F.col("_n") == 1, F.col("c0")).otherwise(F.sha2(F.concat_ws("", *_slots()), 256))


def _levels(nodes: DataFrame, most: int, carry: str | None = None) -> list[DataFrame]:
    """The runs of each level of all groups' trees, from the nodes (_g, _pos, _n, digest) upwards; the last level has
    one run a group.  A group with fewer levels goes through the upper ones with its single node."""
    levels = []
    while True:
        levels.append(materialise(_pivot(nodes, "digest", carry), f"merkle-level-{len(levels)}"))
        if most <= FANOUT:
            return levels
        nodes = levels[-1].select("_g", F.col("_run").alias("_pos"), F.ceil(F.col("_n") / FANOUT).alias("_n"), _digest().alias("digest"))
        most, carry = -(-most // FANOUT), None


def _children(runs: DataFrame, above: DataFrame, carry: bool = False) -> DataFrame:
    """Nodes of the runs with their path, the steps from the node to the root: what stands left and right of it in
    its run, and the path of its run from `above`.  A group's only node is no step."""
    slots = _slots()
    made = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(c).alias("digest"), F.concat_ws("", *slots[:k]).alias("left"), F.concat_ws("", *slots[k + 1:]).alias("right"), *([F.col(f"r{k}").alias("row")] if carry else [])))
        for k, c in enumerate(slots)
    ]
    own = F.array(F.struct(F.col("_c.left").alias("left"), F.col("_c.right").alias("right")))
    rest = [c for c in above.columns if c not in ("_g", "_run", "path")]
    nodes = runs.join(above, ["_g", "_run"]).select("_g", "_run", "_n", "path", *rest, F.explode(F.array_compact(F.array(*made))).alias("_c"))
    path = F.when(F.col("_n") == 1, F.col("path")).otherwise(F.concat(own, "path"))
    return nodes.select("_g", (F.col("_run") * FANOUT + F.col("_c.k")).alias("_run"), path.alias("path"), *rest, F.col("_c.digest").alias("digest"), *([F.col("_c.row").alias("row")] if carry else []))


def _down(levels: list[DataFrame], above: DataFrame, carry: bool = False) -> DataFrame:
    """From the paths of the topmost runs to those of the lowest nodes."""
    for at in range(len(levels) - 1, -1, -1):
        above = _children(levels[at], above, carry and at == 0)
        if at:
            above = above.drop("digest")
    return above


def merkle_manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Digest of every row of docs, of its source and of the whole table, and the proof of each row.

    A leaf is the digest of doc_id, source, lang, n_chars and text.  The leaves of a source, ascending by doc_id, are
    spread sixteen a row into the columns of their parent by conditional aggregates; concatenating the columns gives
    the parent's hash, the columns but the own one give the siblings.  The subroots, ascending by source, likewise
    give the root.  Going down again, each run hands its path to its children, so a leaf ends with all siblings up to
    the root, from which its root is folded.  `tampered` replaces columns for the leaf that is folded, in rows `where`.

    Returns a row for each row: doc_id, leaf, subroot, root, proof_sha256 (of all siblings, level by level, left to
    right), folded_root, verified.
    Ranges, not sources, are what tasks get, so a source of any size or any number of sources is fine.  A null source
    is a source of its own, the first; a null doc_id comes before all others and is not tampered with where `where`
    is null; equal doc_ids are ordered by their leaves, and equal rows are alike in every column but their siblings;
    null and empty texts have different leaves; an empty table gives no rows.  Other columns are not read.
    """
    leaf = leaf_digest([F.col(c) for c in FIELDS])
    other = leaf_digest([(tampered or {}).get(c, F.col(c)) for c in FIELDS])
    group = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = docs.select(group.alias("_g"), "doc_id", leaf.alias("digest"), (F.when(where, other) if where is not None else F.lit(None).cast("string")).alias("other"))
    leaves, most = numbered(rows, ["_g"], ["doc_id", "digest"], "merkle-leaves")
    trees = _levels(leaves.withColumn("row", F.struct("doc_id", "other")), max(most, 1), "row")
    subs, sources = numbered(trees[-1].select("_g", _digest().alias("digest")), [], ["_g"], "merkle-subroots")
    subs = materialise(subs, "merkle-subroot-places")
    top = _levels(subs.withColumn("_g", F.lit("")), max(sources, 1))
    root = top[-1].select("_g", "_run", F.array().cast(STEP).alias("path"), _digest().alias("root"))
    placed = _down(top, root).select(F.col("_run").alias("_pos"), "path", "root", F.col("digest").alias("subroot"))
    above = subs.select("_g", "_pos").join(placed, "_pos").select("_g", F.lit(0).cast("long").alias("_run"), "path", "root", "subroot")
    proven = _down(trees, above, carry=True)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("row.other", "digest"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    out = proven.select(F.col("row.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
