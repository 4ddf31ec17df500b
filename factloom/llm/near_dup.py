"""Near-duplicate documents by b-bit MinHash.

Of each document's minima the low two bits are kept and packed into four 64-bit numbers.  Bands of whole minima
give candidates; the share of equal bit pairs, counted with bit_count and corrected for chance collisions,
estimates the similarity of a candidate pair; what may reach the threshold is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, MAX_REMEMBERED, discard, hot_keys, in_small_batches, materialise, spread_join, text_slices, texts_of

WORDS = 5
#: 25 bands of 5 minima: a pair of similarity 0.85 shares no band with probability 4e-7.
BANDS, ROWS = 25, 5
MINIMA, BITS = 128, 2
#: Pairs estimated this far below the threshold are not confirmed: over four standard errors of the estimate.
MARGIN = 0.17
#: Members that are compared with one document in one task, about.
MEMBERS = 2000
#: Members of a band on either side of what one task compares: texts, and signatures alone.
BLOCK, SIGNATURE_BLOCK = 256, 2048

_RNG = np.random.default_rng(20240607)
_MUL = (_RNG.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_POSITION = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of five words; A-Z count as a-z; of a text with
    fewer words the whole sequence is the one shingle."""
    words = text.encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    k = min(n, WORDS)
    out = h[: n - k + 1] * _POSITION[0]
    for i in range(1, k):
        out = out + h[i : n - k + 1 + i] * _POSITION[i]
    out += np.uint64(k)
    out ^= out >> np.uint64(33)
    out *= _MIX
    out ^= out >> np.uint64(33)
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(16)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (_MUL[:, None] * x[None, at : at + 512] + _ADD[:, None]).min(axis=1), out=low)
    return low


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed low bits of the minima (int64) and the keys of the bands (int64)."""
    low = minima(hashes)
    bits = (low & np.uint32(3)).astype(np.uint64).reshape(4, 32)
    packed = (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :]).sum(axis=1, dtype=np.uint64)
    rows = np.ascontiguousarray(low[: BANDS * ROWS].reshape(BANDS, ROWS))
    keys = [xxhash.xxh3_64_intdigest(rows[b].tobytes(), seed=b) for b in range(BANDS)]
    return packed.view(np.int64), np.array(keys, np.uint64).view(np.int64)


_SIGNATURES = "doc_id long, n_shingles long, set_hi long, set_lo long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = np.zeros(0, np.int64)
    for b in text_slices(batches):
        n, sets, packed, keys = [], [], [], []
        for t in texts_of(b):
            h = shingles(t)
            s, k = signature(h) if len(h) else (np.zeros(4, np.int64), nothing)
            n.append(len(h))
            sets.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64))
            packed.append(s)
            keys.append(k)
        sets, packed = np.array(sets).reshape(-1, 2), np.array(packed).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *[pa.array(sets[:, i]) for i in range(2)], *[pa.array(packed[:, i]) for i in range(4)], pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_hi", "set_lo", "s0", "s1", "s2", "s3", "bands"],
        )


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity from packed signatures: equal bit pairs, less those that are equal by chance."""
    low = 0x5555555555555555
    unequal = sum((F.bit_count((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(low))) for x, y in zip(a, b, strict=True)), F.lit(0))
    chance = 1 / (1 << BITS)
    return ((1 - unequal / MINIMA) - chance) / (1 - chance)


def _confirm(percent: int):
    """Stream rows ordered by (lead, part, is_member): a lead's text comes first and its set is kept while its
    members pass by, so a task holds two sets at a time however many members there are."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for b in text_slices(batches):
            leads, parts, members, ids = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lead", "part", "is_member", "doc_id"))
            out_a, out_b = [], []
            for lead, part, member, doc, text in zip(leads, parts, members, ids, texts_of(b), strict=True):
                if (lead, part) != at:
                    at, own = (lead, part), []
                h = shingles(text)
                if not member:
                    own.append(h)
                    continue
                for o in own:
                    both = len(np.intersect1d(o, h, assume_unique=True))
                    if 100 * both >= percent * (len(o) + len(h) - both):
                        out_a.append(lead)
                        out_b.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return confirm


def confirmed_links(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Both sides are ids of docs; no pairs give no links; pairs with an id that docs lacks, or a null one, give none.
    """
    pairs = materialise(pairs.select("a", "b").distinct(), "near-pairs")
    most = pairs.groupBy("a").count().agg(F.max("count")).first()[0]
    if most is None:
        return pairs
    # a lead's text is repeated for each part that has members of it, so there are no more copies than members
    part = F.pmod(F.xxhash64("b"), F.lit(-(-most // MEMBERS))).cast("int")
    asked = pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("lead"), part.alias("part"), F.lit(True).alias("is_member"))
    asked = materialise(asked.unionByName(pairs.select(F.col("a").alias("doc_id"), F.col("a").alias("lead"), part.alias("part"), F.lit(False).alias("is_member")).distinct()), "near-asked")
    texts = docs.select("doc_id", "text")
    ids = asked.select("doc_id").distinct()
    if ids.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")  # checked: only texts that are asked for move
    rows = asked.join(texts, "doc_id").repartition("lead", "part").sortWithinPartitions("lead", "part", "is_member")
    links = materialise(rows.mapInArrow(_confirm(percent), "a long, b long").distinct(), "near-links")
    discard(pairs, asked)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, component: for every node of links (a, b) the smallest node it reaches.

    Labels spread along links and are then followed from label to label until nothing changes, each round
    written to the shared folder; the driver only sees whether a round changed anything.  A node with a large share
    of all links is dealt over several tasks.  Links of a node with itself or with null, and repeated ones, change
    nothing; no links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where("a <> b").distinct(), "links")
    hubs = hot_keys(both.groupBy("b").count(), ["b"], "count", both.count())
    before = labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        seen = spread_join(both, labels.withColumnRenamed("node", "b"), ["b"], hubs, "a").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(seen, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        step = materialise(step, "labels")
        heads = hot_keys(step.groupBy("component").count(), ["component"], "count", step.count())
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = materialise(spread_join(step, jump, ["component"], heads, "node", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        discard(step, before)
        before, labels = after, after.select("node", "component")
        if after.where("component <> old").isEmpty():
            discard(both)
            return labels


def deal_sides(members: DataFrame, block: int) -> DataFrame:
    """Rows (band, rep, component) dealt so that any two members of a band and of different components meet.

    In each band the largest component is one side and all others the other side, each cut into blocks of about
    `block` members.  Blocks of the other side meet those of the largest component and each other, so a band of n
    members of which m are outside its largest component gives n * m / block + m * n / block rows at most, about n
    where few are outside.  Adds task_a, task_b and side (0: the first block of a task, 1: the second, 2: both).
    """
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    bands = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"))
    bands = bands.select("band", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / block).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("main.n")) / block).cast("int").alias("outer"), "all").where("outer > 0")
    hot = hot_keys(bands, ["band"], "all", members.count())
    rows = spread_join(members, bands.drop("all"), ["band"], hot, "rep")
    inside = rows.where("component = main").withColumn("task_a", F.pmod(F.xxhash64("rep"), F.col("inner")).cast("int")).withColumn("task_b", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).withColumn("side", F.lit(0))
    own = F.pmod(F.xxhash64("rep"), F.col("outer")).cast("int")
    outside = rows.where("component <> main").withColumn("own", own)
    against = outside.withColumn("task_a", F.explode(F.sequence(F.lit(0), F.col("inner") - 1))).withColumn("task_b", F.col("own")).withColumn("side", F.lit(1))
    # blocks of the other side among themselves: tasks below 0 in task_a
    among = outside.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))
    among = among.withColumn("task_a", -1 - F.least("own", "with")).withColumn("task_b", F.greatest("own", "with")).withColumn("side", F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)).drop("with")
    cols = [*members.columns, "task_a", "task_b", "side"]
    return inside.select(*cols).unionByName(against.select(*cols)).unionByName(among.select(*cols))


def _likely(least: float):
    """Of each task's two sides the members that some member of another component on the other side may be like, by
    their signatures: band, rep."""
    chance = 1 / (1 << BITS)
    most = int((1 - (least * (1 - chance) + chance)) * MINIMA)  # unequal minima of a pair that is estimated at least that
    low = np.uint64(0x5555555555555555)

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = [r for r in rows if r[5] != 1], [r for r in rows if r[5] != 0]
        if not left or not right:
            return []
        x, y = (np.array([r[6:10] for r in side], np.int64).view(np.uint64) for side in (left, right))
        cx, cy = (np.array([r[2] for r in side], np.int64) for side in (left, right))
        hit_x, hit_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for i in range(0, len(x), 64):
            unequal = np.zeros((min(64, len(x) - i), len(y)), np.uint8)
            for k in range(4):
                z = x[i : i + 64, k, None] ^ y[None, :, k]
                unequal += np.bitwise_count((z | (z >> np.uint64(1))) & low)
            near = (unequal <= most) & (cx[i : i + 64, None] != cy[None, :])
            hit_x[i : i + 64] = near.any(axis=1)
            hit_y |= near.any(axis=0)
        return [(r[0], r[1]) for side, hit in ((left, hit_x), (right, hit_y)) for r, h in zip(side, hit, strict=True) if h]

    return _grouped(compare, ("band", "rep", "component", "task_a", "task_b", "side", "s0", "s1", "s2", "s3"), ("band", "rep"))


def _grouped(compare, columns: tuple, names: tuple):
    """Collect the rows of one task (band, task_a, task_b), which its dealing bounds, and yield what compare gives."""
    at = [columns.index(c) for c in ("band", "task_a", "task_b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], names=list(names))

        for b in text_slices(batches):
            found: list[tuple] = []
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
                if group and any(row[i] != group[0][i] for i in at):
                    found += compare(group)
                    group = []
                group.append(row)
            if found:
                yield out(found)
        if group and (found := compare(group)):
            yield out(found)

    return run


def links_across(docs: DataFrame, classes: DataFrame, banded: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components in bands that hold several.

    Signatures are compared first: only members that some member of another component may be like, by the estimate,
    go on.  Their texts are then dealt in blocks; a pair counts in the first band that it shares; of the links found
    only those that join two components are returned.
    """
    placed = materialise(banded.select("band", "at", "rep", "s0", "s1", "s2", "s3").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    dealt = deal_sides(placed, SIGNATURE_BLOCK).repartition("band", "task_a", "task_b").sortWithinPartitions("band", "task_a", "task_b")
    likely = materialise(dealt.select("band", "rep", "component", "task_a", "task_b", "side", "s0", "s1", "s2", "s3").mapInArrow(_likely(percent / 100 - MARGIN), "band long, rep long").distinct(), "likely")
    if likely.isEmpty():
        discard(placed)
        return likely.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    members = materialise(placed.select("band", "at", "rep", "component").join(likely, ["band", "rep"], "left_semi"), "mixed")
    ids = materialise(members.select("rep").distinct(), "mixed-ids")
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    if ids.count() <= BROADCAST_ROWS:
        texts, classes = texts.join(F.broadcast(ids), "rep", "left_semi"), classes.join(F.broadcast(ids), "rep", "left_semi")
    texts = texts.join(classes.select("rep", "bands"), "rep")
    rows = deal_sides(members, BLOCK).join(texts, "rep").repartition("band", "task_a", "task_b").sortWithinPartitions("band", "task_a", "task_b", "rep")
    links = materialise(rows.select("band", "at", "rep", "component", "task_a", "task_b", "side", "text", "bands").mapInArrow(_compare_blocks(percent), "a long, b long").distinct(), "near-links")
    discard(placed, likely, members, ids)
    return links


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right, by products of membership matrices over
    the values that both sides have."""
    x, y = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(x, y)
    rows = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (left, right)]
    at = [np.searchsorted(common, v) for v in (x, y)]
    found = [np.flatnonzero(common[np.minimum(p, len(common) - 1)] == v) if len(common) else np.zeros(0, int) for p, v in zip(at, (x, y), strict=True)]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(common), 8192):
        m = []
        for k, s in enumerate((left, right)):
            keep = found[k][(at[k][found[k]] >= start) & (at[k][found[k]] < start + 8192)]
            one = np.zeros((len(s), min(8192, len(common) - start)), np.float32)
            one[rows[k][keep], at[k][keep] - start] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _compare_blocks(percent: int):
    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        at = group[0][1]
        left, right = [g for g in group if g[6] != 1], [g for g in group if g[6] != 0]
        if not left or not right:
            return []
        sets = [[shingles(g[7] or "") for g in side] for side in (left, right)]
        both = _shared(*sets)
        size = [np.array([len(s) for s in side]) for side in sets]
        linked = 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)
        linked &= np.array([g[3] for g in left])[:, None] != np.array([g[3] for g in right])[None, :]
        bands = [np.array([g[8] for g in side]) for side in (left, right)]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            if left[i][2] == right[j][2] or np.argmax(bands[0][i] == bands[1][j]) != at:
                continue
            x, y = find(left[i][3]), find(right[j][3])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((left[i][2], right[j][2]))
        return out

    return _grouped(compare, ("band", "at", "rep", "component", "task_a", "task_b", "side", "text", "bands"), ("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union, and find what they reach.

    Documents of equal sets are one class with the smallest doc_id as its representative.  Representatives that
    share a band are compared with the band's smallest member first; bands whose members are not all in one
    component after that are gone through again, components against each other, by signatures and then by texts.
    So every candidate pair is compared or known to be connected already, and a group of n copies leads to about n
    rows.  Shingles are told apart by 64-bit hashes of their words, and two sets count as equal where the 128-bit
    digests of their sorted hashes are.

    Returns for every row: doc_id, n_shingles, component_id, kept.  A null text counts as empty; empty texts are
    linked with nothing; rows that share a doc_id count as one document; rows with a null doc_id are linked with
    nothing, have component_id null and are kept; an empty table gives an empty result.  Columns of docs other
    than doc_id and text are not read.
    """
    in_small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(docs.mapInArrow(_sign, _SIGNATURES), "signatures")
    sig = ["s0", "s1", "s2", "s3"]
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(usable.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in (*sig, "bands")]), "classes")
    # documents that share a doc_id but not a set are linked without a comparison
    ids = usable.groupBy("doc_id").agg(F.min(F.struct("set_hi", "set_lo")).alias("x"), F.max(F.struct("set_hi", "set_lo")).alias("y"))
    same = usable.select("set_hi", "set_lo", "doc_id").join(ids.where("x <> y"), "doc_id", "left_semi")
    banded = materialise(classes.select("rep", *sig, F.posexplode("bands").alias("at", "band")), "bands")
    leads = materialise(banded.groupBy("band").agg(F.min(F.struct("rep", *sig)).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leads")
    least = percent / 100 - MARGIN
    own, lead = [F.col(c) for c in sig], [F.col(f"lead.{c}") for c in sig]
    pairs = spread_join(banded, leads.select("band", "lead"), ["band"], hot_keys(leads, ["band"], "n", banded.count()), "rep")
    pairs = pairs.where((F.col("rep") > F.col("lead.rep")) & (estimate(own, lead) >= least))
    links = confirmed_links(docs, pairs.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")), percent)
    twins = materialise(same.join(classes.select("set_hi", "set_lo", "rep"), ["set_hi", "set_lo"]).where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "twins")
    links = links.unionByName(twins)
    labels = components(links)
    extra = links_across(docs, classes, banded.join(leads.select("band"), "band", "left_semi"), labels, percent)
    if not extra.isEmpty():
        labels = components(links.unionByName(extra))
    discard(banded, leads)
    reached = classes.select("set_hi", "set_lo", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("_component"))
    copied = hot_keys(classes, ["set_hi", "set_lo"], "n", signed.count())
    out = spread_join(signed.select("doc_id", "n_shingles", "set_hi", "set_lo"), reached, ["set_hi", "set_lo"], copied, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.coalesce(component, F.lit(0)) == F.coalesce("doc_id", F.lit(0))).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; of rows that share a doc_id all stay
    or none.  Edge cases are those of near_duplicates."""
    dropped = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    dropped = materialise(dropped, "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
