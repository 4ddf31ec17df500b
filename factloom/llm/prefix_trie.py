"""The prefix trie of conversations, built range by range as adaptive radix trees over fixed-width turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, hot_keys, in_small_batches, materialise, spread_join

#: Bytes of a turn id: the first of the turn's SHA-256, as they stand.
WIDTH = 16
#: Bytes of keys that a tree holds at most, but for one key.
TREE_BYTES = 16 << 20

NODE = "node binary, part int, shared boolean, depth long, conv_id long, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, ends_sha256 string"
MERGED = "node binary, depth long, conv_id long, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class _Radix:
    """A node of an adaptive radix tree: a compressed path, then a byte that picks the child.  The layout grows from 4
    and 16 bytes searched side by side to 48 children behind a table of all bytes and to a slot for each byte."""

    __slots__ = ("prefix", "ends", "chars", "layout", "bytes", "kids")

    def __init__(self, prefix: bytes, chars: list):
        self.prefix, self.chars, self.ends = prefix, chars, None
        self.layout, self.bytes, self.kids = 4, bytearray(), []

    def find(self, byte: int):
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, child: _Radix) -> None:
        """A new child, or another one in the place of a child."""
        if self.layout == 256:
            self.kids[byte] = child
        elif self.layout == 48 and self.bytes[byte]:
            self.kids[self.bytes[byte] - 1] = child
        elif self.layout <= 16 and (at := self.bytes.find(byte)) >= 0:
            self.kids[at] = child
        elif len(self.kids) == self.layout:
            self._grow()
            self.put(byte, child)
        elif self.layout == 48:
            self.kids.append(child)
            self.bytes[byte] = len(self.kids)
        else:
            self.bytes.append(byte)
            self.kids.append(child)

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            table = bytearray(256)
            for at, byte in enumerate(self.bytes):
                table[byte] = at + 1
            self.layout, self.bytes = 48, table
        else:
            self.layout, self.bytes, self.kids = 256, None, [self.kids[at - 1] if at else None for at in self.bytes]

    def ascending(self) -> list[_Radix]:
        if self.layout == 256:
            return [kid for kid in self.kids if kid is not None]
        if self.layout == 48:
            return [self.kids[at - 1] for at in self.bytes if at]
        return [kid for _, kid in sorted(zip(self.bytes, self.kids), key=lambda pair: pair[0])]


def _common(a: bytes, b: bytes) -> int:
    """How many bytes a and b begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _insert(root: _Radix, key: bytes, conv: int, chars: list) -> None:
    node, depth = root, 0
    while True:
        rest = key[depth:depth + len(node.prefix)]
        alike = len(rest) if rest == node.prefix else _common(rest, node.prefix)
        if alike < len(node.prefix):  # the path is cut where the key leaves it
            below = _Radix(node.prefix[alike + 1:], node.chars)
            below.ends, below.layout, below.bytes, below.kids = node.ends, node.layout, node.bytes, node.kids
            byte = node.prefix[alike]
            node.prefix, node.ends, node.layout, node.bytes, node.kids = node.prefix[:alike], None, 4, bytearray(), []
            node.put(byte, below)
        depth += alike
        if depth == len(key):
            if node.ends is None:
                node.ends = []
            node.ends.append(conv)
            return
        child = node.find(key[depth])
        if child is None:
            child = _Radix(key[depth + 1:], chars)
            child.ends = [conv]
            node.put(key[depth], child)
            return
        node, depth = child, depth + 1


def _ids(key: bytes) -> list[bytes]:
    """The name of each turn-aligned beginning of key: a digest of its bytes."""
    state, names = hashlib.sha256(), []
    names.append(state.digest()[:WIDTH])
    for at in range(0, len(key), WIDTH):
        state.update(key[at:at + WIDTH])
        names.append(state.copy().digest()[:WIDTH])
    return names


def _tree_rows(part: int, keys: list[bytes], convs: list[int], chars: list[list], before: int, after: int) -> Iterator[tuple]:
    """Rows of NODE for ascending keys.  The nodes of the first key up to the depth `before` go on from the range
    before, those of the last key up to `after` go on in the next range (-1: none does); they are `shared`, and what
    is told of them here adds up over ranges.  Such a node counts as a child, and once against its savings, in the
    first range that has it, and as a leaf in the last."""
    root = _Radix(keys[0], chars[0])
    root.ends = []
    for key, conv, own in zip(keys, convs, chars):
        _insert(root, key, conv, own)
    depth, parent, ends, length = [], [], [], []
    stack = [(root, -1, -1)]
    while stack:  # from the top down; only turn-aligned byte depths are nodes
        node, above, up = stack.pop()
        end = len(node.prefix) if above < 0 else above + 1 + len(node.prefix)
        for at in range(0 if above < 0 else (above // WIDTH + 1) * WIDTH, end + 1, WIDTH):
            depth.append(at // WIDTH)
            parent.append(up)
            ends.append((node.ends or ()) if at == end else ())
            length.append(node.chars[at // WIDTH - 1] if at else 0)
            up = len(depth) - 1
        stack.extend((kid, end, up) for kid in reversed(node.ascending()))
    size = len(depth)
    goes_on, went_on, name = [False] * size, [False] * size, {}
    for flags, edge, least, key in ((went_on, 0, before, keys[0]), (goes_on, -1, after, keys[-1])):
        at, names = [i for i in range(size) if ends[i]][edge], _ids(key)
        while at >= 0:
            if depth[at] <= least:
                flags[at], name[at] = True, names[depth[at]]
            at = parent[at]
    count = [len(e) for e in ends]
    least = [e[0] if e else None for e in ends]
    kids, any_kid, leaves, saved = [0] * size, [False] * size, [0] * size, [0] * size
    for i in range(size - 1, -1, -1):  # from the bottom up
        if not any_kid[i] and not goes_on[i]:
            leaves[i] = 1
        saved[i] += (count[i] - (not went_on[i])) * length[i]
        if (up := parent[i]) >= 0:
            any_kid[up] = True
            kids[up] += not went_on[i]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            count[up] += count[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
    for i in range(size):
        told = ",".join(map(str, ends[i])).encode()
        up = parent[i]
        apart = i not in name
        yield (
            None if apart else name[i], part, not apart, depth[i], least[i], name.get(up), None if up < 0 or up in name else least[up], count[i], kids[i], leaves[i], saved[i],
            None if apart else told, hashlib.sha256(told).hexdigest() if apart else None,
        )


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _build(common: dict[int, tuple[int, int]]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part, own in groupby(_plain(batches), key=lambda row: row[0]):
                _, keys, convs, chars = zip(*own)
                yield from _tree_rows(part, keys, convs, chars, *common[part])

        yield from _batches(rows(), _arrow(NODE))

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared nodes, whose parts stand one after another: sums, the smallest conv_id, and one digest of all ends."""
    def rows():
        for node, parts in groupby(_plain(batches), key=lambda row: row[0]):
            digest, any_end, sums, least = hashlib.sha256(), False, [0, 0, 0, 0], None
            for _, _, depth, conv, parent, *numbers, ends in parts:
                if ends:
                    digest.update(b"," + ends if any_end else ends)
                    any_end = True
                sums = [a + b for a, b in zip(sums, numbers)]
                least = conv if least is None else min(least, conv)
            yield (node, depth, least, parent, *sums, digest.hexdigest())

    yield from _batches(rows(), _arrow(MERGED))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many turns the edges of neighbouring ranges begin with alike; -1 without a neighbour."""
    def alike(a, b):
        return -1 if a is None or b is None else _common(a, b) // WIDTH

    schema = _arrow("part int, before int, after int")
    yield from _batches(((part, alike(last, low), alike(high, first)) for part, low, high, last, first in _plain(batches)), schema)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id: turns, its turns in order as array<struct<id, chars>>: the id in hex, of role and text,
    and the text's code points.

    Ordered by turn, null first; turns of one number by their ids.  Null roles and texts are empty; rows without a
    conv_id are left out; repeated rows are turns of their own.  A conversation's ids stand in one row, 16 bytes a turn;
    no text is gathered."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", name.alias("id"), F.char_length(text).cast("long").alias("chars"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie of all sequences (conv_id, turns), a row for each node: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (what sharing the texts of the subtree saves, in code
    points) and ends_sha256 (of the conv_ids that end here, ascending, with commas).

    Sequences become keys of fixed-width ids and are dealt by ranges of key and conv_id, so copies of one conversation
    spread too.  Each range is an adaptive radix tree with compressed paths; only byte depths where a turn ends become
    nodes.  Nodes that stand in several ranges begin the last key of one and the first key of the next; their sums are
    then added, and their ends, a short text for each range, go through one digest in order.

    A null list of turns counts as empty, and a conversation without turns is a member of the root; rows without a
    conv_id are left out; without a conversation there is no node; a conv_id that comes twice counts twice.
    """
    spark = sequences.sparkSession
    in_small_batches(spark)
    turns = F.coalesce("turns", F.array().cast("array<struct<id:string,chars:bigint>>"))
    keyed = sequences.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join(F.transform(turns, lambda t: t["id"]), "")).alias("key"), F.transform(turns, lambda t: t["chars"]).alias("chars"))
    keyed = materialise(keyed, "trie-sequences")
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TREE_BYTES + 1)
    keyed = materialise(keyed.repartitionByRange(n, "key", "conv_id").select(F.spark_partition_id().alias("part"), "key", "conv_id", "chars"), "trie-keys")
    edges = keyed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # a row a range
    edges = edges.select("part", "low", "high", F.lag("high").over(order).alias("last"), F.lead("low").over(order).alias("first"))
    common = {r.part: (r.before, r.after) for r in edges.mapInArrow(_aligned, "part int, before int, after int").collect()}  # three numbers a range
    sorted_keys = keyed.repartition(n, "part").sortWithinPartitions("part", "key", "conv_id")
    nodes = materialise(sorted_keys.mapInArrow(_build(common), NODE), "trie-nodes")
    parts = nodes.where("shared").select("node", "part", "depth", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    shared = materialise(parts.repartition(n, "node").sortWithinPartitions("node", "part").mapInArrow(_merge, MERGED), "trie-shared")
    apart = nodes.where(~F.col("shared"))
    below = apart.where(F.col("parent").isNotNull()).drop("parent_conv_id").unionByName(shared.where("depth > 0"), allowMissingColumns=True)
    names = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    if names.count() <= BROADCAST_ROWS:
        below = below.join(F.broadcast(names), "parent")
    else:
        by_parent = below.groupBy("parent").count()
        below = spread_join(below, names, ["parent"], hot_keys(by_parent, ["parent"], "count", below.count()), "conv_id")
    top = shared.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return apart.where(F.col("parent").isNull()).select(*RESULT).unionByName(below.select(*RESULT)).unionByName(top.select(*RESULT))
