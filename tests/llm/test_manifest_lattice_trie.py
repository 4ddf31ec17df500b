"""The manifest, the lattice scores and the trie against plain readings of their definitions."""

import hashlib
import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import prefix_trie, slot_merkle, subword_lattice
from factloom.llm.common import fold, numbered
from factloom.llm.queries import piece_vocabulary, rebranched

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, tamper):
    """Recursive reading: every tree by hand, the proof found by walking up."""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def walk(levels, at):
        for level in levels[:-1]:
            run = at // 16 * 16
            yield level[run:at], level[at + 1:run + 16]
            at //= 16

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = build([leaf(r) for r in by_source[s]])
    top = build([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, row in enumerate(by_source[s]):
            steps = [*walk(trees[s], at), *walk(top, k)]
            value = leaf(tamper(row))
            for left, right in steps:
                value = sha("".join(left) + value + "".join(right))
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[s][-1][0], root, sha("".join("".join(a + b) for a, b in steps)), value, value == root))
    return out


def lower(row):
    changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])) if changed else row


@pytest.mark.parametrize("sources", [["a"], ["a", None, "B", "é", ""], [f"s{k}" for k in range(40)]])
def test_manifest(spark, sources):
    """Nulls in every column, one source and many, sources of one row, lone last runs, texts with letters to lower."""
    rnd = random.Random(len(sources))
    rows = [(None if i == 7 else i - 3, sources[rnd.randrange(len(sources))] if i > 5 else sources[0], rnd.choice([None, "en"]), rnd.choice([None, 3]), rnd.choice([None, "", "ÀB c", "abc", f"Text {i}"])) for i in range(278)]
    rows.append((1000, "alone", None, None, "x"))
    found = slot_merkle.merkle_manifest(spark.createDataFrame(rows, DOCS), {"text": slot_merkle.ascii_lower("text")}, fold("doc_id", 5) == 0)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_manifest(rows, lower), key=repr)


def test_manifest_of_repeated_rows_and_of_few(spark):
    rows = [(1, "a", "en", 1, "Same")] * 40 + [(None, None, None, None, None)] * 20
    for some in (rows, rows[:17], rows[-1:]):
        found = slot_merkle.merkle_manifest(spark.createDataFrame(some, DOCS))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_manifest(some, lambda r: r), key=repr)
        assert found.where("verified").count() == len(some)
    assert slot_merkle.merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_a_changed_field_of_any_kind_is_seen(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(60)]
    for field, other in (("source", F.lit("s9")), ("text", F.lit(None).cast("string"))):
        found = slot_merkle.merkle_manifest(spark.createDataFrame(rows, DOCS), {field: other}, F.col("doc_id") % 7 == 0)
        assert {r.doc_id for r in found.where("not verified").collect()} == set(range(0, 60, 7))


def test_numbered(spark):
    rows = [("a", i % 50) for i in range(500)] + [("b", 1), (None, 2), (None, 1)]
    out, most = numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], "numbered")
    got = sorted((r.g or "", r._pos, r.v, r._n) for r in out.collect())
    want = [("", 0, 1, 2), ("", 1, 2, 2)] + [("a", k, v, 500) for k, v in enumerate(sorted(v for g, v in rows if g == "a"))] + [("b", 0, 1, 1)]
    assert got == want and most == 500


# --- lattice

def all_ways(s, log):
    """Sum over all cuts of s, one by one."""
    total = 0.0
    for cuts in itertools.product((False, True), repeat=len(s) - 1):
        parts, part = [], s[0]
        for cut, c in zip(cuts, s[1:]):
            if cut:
                parts.append(part)
                part = ""
            part += c
        p = 1.0
        for part in [*parts, part]:
            if part in log:
                p *= math.exp(log[part])
            elif len(part) == 1:
                p *= math.exp(sum(log[f"<0x{b:02X}>"] for b in part.encode()))
            else:
                p = 0.0
        total += p
    return total


def test_forward_recursion_sums_all_segmentations():
    log = {p: math.log(w) for p, w in {"▁": 0.1, "▁a": 0.1, "a": 0.1, "b": 0.05, "ab": 0.2, "ba": 0.1, "aba": 0.05, "▁ab": 0.05}.items()}
    log |= {f"<0x{b:02X}>": math.log(0.0001) for b in range(256)}
    for word in ("a", "b", "ab", "ababa", "bbab", "aéb", "c", "▁a"):
        assert math.exp(subword_lattice.log_marginal(word, log, 4)) == pytest.approx(all_ways("▁" + word, log))
    assert subword_lattice.log_marginal("ab" * 20000, log, 4) < -10000  # no underflow


def test_weights_of_the_vocabulary_are_positive_and_probabilities_sum_to_one(spark):
    pieces, weights = subword_lattice.vocabulary(piece_vocabulary())
    assert len(pieces) == len(set(pieces)) == len(weights) and min(weights) > 0
    counts = spark.createDataFrame([(b"the", 5), (b"w\xc3\xb6rld", 2), ("\U0001f9ff".encode(), 1)], "word binary, c long")
    log = subword_lattice.piece_logs(counts, 3, piece_vocabulary())
    assert sum(map(math.exp, log.values())) == pytest.approx(1)
    assert log["▁the"] > log["▁Device"]


def plain_scores(rows, log):
    """(doc_id, text) -> values, by counting in plain Python."""
    def tokens(text):
        return [w for w in (text or "").encode().lower().split()] + ["</s>"]

    train = [t for i, text in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text)]
    c = {}
    for t in train:
        c[t] = c.get(t, 0) + 1
    n, v = len(train), len(c)
    longest = max(map(len, log))
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((c.get(t, 0) + 1) / (n + v + 1)) for t in own)
        model = sum(log["</s>"] if t == "</s>" else subword_lattice.log_marginal(t.decode(), log, longest) for t in own) / math.log(10)
        yield i, len(own), sum(t in c for t in own), n, base, model


@pytest.mark.parametrize("frequent", [0, 3, 200_000])
def test_scores(spark, monkeypatch, frequent):
    """With all words joined, some and none; null, empty and long texts, repeated rows, rows without an id."""
    monkeypatch.setattr(subword_lattice, "FREQUENT", frequent)
    monkeypatch.setattr(subword_lattice, "COUNTED", 5)
    rnd = random.Random(3)
    words = ["the", "The", "cat", "ÄB", "zq", "x" * 300, "\U0001f9ff", "thé", "a b"]
    rows = [(i, " ".join(rnd.choice(words[: 2 + i % 8]) for _ in range(rnd.randrange(30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n\x0b"), (None, "the cat"), (None, None), rows[5], rows[5], (103, "w " * 5000), (104, "nowhere else\x0cseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learns = ~F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    seen = {}
    real = subword_lattice.piece_logs
    monkeypatch.setattr(subword_lattice, "piece_logs", lambda *a: seen.setdefault("log", real(*a)))
    got = sorted(map(tuple, subword_lattice.lattice_scores(docs, learns, piece_vocabulary()).collect()), key=repr)
    want = sorted(plain_scores(rows, seen["log"]), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:])


def test_scores_without_training_rows_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in subword_lattice.lattice_scores(docs, F.lit(False), piece_vocabulary()).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].n_tokens == 3 and got[1].base_score == 0 and got[1].score < got[2].score < 0
    assert subword_lattice.lattice_scores(docs.limit(0), F.lit(True), piece_vocabulary()).collect() == []


def test_texts_of_the_corpus_are_likelier_than_shuffled_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rnd = random.Random(1)
    some = [(-r.doc_id - 1, " ".join("".join(rnd.sample(w, len(w))) for w in r.text.split())) for r in docs.limit(40).collect()]
    both = docs.union(spark.createDataFrame(some, docs.schema))
    got = {r.doc_id: r.score for r in subword_lattice.lattice_scores(both, F.col("doc_id") >= 0, piece_vocabulary()).collect()}
    assert sum(got[-i - 1] <= got[i] for i, _ in ((-k - 1, 0) for k, _ in some)) >= 0.95 * len(some)


# --- trie

def plain_trie(sequences):
    """conv_id -> list of (id, chars); nodes by their whole paths."""
    members, chars, out = {}, {(): 0}, []
    for conv, turns in sequences:
        for d in range(len(turns) + 1):
            path = tuple(t[0] for t in turns[:d])
            members.setdefault(path, []).append((conv, d == len(turns)))
            if d:
                chars[path] = turns[d - 1][1]
    for path, own in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * chars[p] for p in below)
        up = min(c for c, _ in members[path[:-1]]) if path else None
        ends = ",".join(map(str, sorted(c for c, e in own if e)))
        out.append((min(c for c, _ in own), len(path), up, len(own), len(kids), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


SEQUENCES = "conv_id long, turns array<struct<id:string,chars:bigint>>"


def turn(k):
    return (hashlib.sha256(str(k).encode()).hexdigest()[:32], k % 11)


@pytest.mark.parametrize("width", [1, 2, 5, 300])
def test_trie(spark, width, monkeypatch):
    """Few and many branches (all four layouts), copies, beginnings of others, sequences without turns, negative ids."""
    rnd = random.Random(width)
    rows = [(i - 40, [turn(rnd.randrange(width)) for _ in range(rnd.randrange(6))]) for i in range(420)]
    rows += [(5000 + i, [turn(0), turn(0)]) for i in range(60)]
    for tree_bytes in (1 << 24, 1 << 10):
        monkeypatch.setattr(prefix_trie, "TREE_BYTES", tree_bytes)
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SEQUENCES))
        assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_long_copies_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TREE_BYTES", 1 << 12)
    long = [turn(k) for k in range(150)]
    rows = [(i, long) for i in range(12)] + [(20, long[:70]), (21, [*long[:100], turn(999)]), (22, []), (23, None)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SEQUENCES))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie([(c, t or []) for c, t in rows])


def test_trie_by_shuffled_names(spark, monkeypatch):
    """Parents found by a shuffled join when there are too many shared nodes to broadcast."""
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(prefix_trie, "TREE_BYTES", 1 << 10)
    rows = [(i, [turn(i % 7), turn(i)]) for i in range(300)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SEQUENCES))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_odd_conversations(spark):
    """Null ids, turns, roles and texts, equal turns, repeated rows, extra columns, long texts; empty tables."""
    rows = [(1, 0, "user", "a"), (1, None, "user", "first"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "", ""), (None, 0, "user", "a"), (3, 1, "user", "x" * 70000), (100, 0, "user", "é"), (101, 0, "user", "own")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, key string").withColumns({c: F.lit(1) for c in ("node", "part", "turns", "depth")})
    found = {r.conv_id: [t.chars for t in r.turns] for r in prefix_trie.turn_sequences(table).collect()}
    assert found == {1: [5, 1, 1], 2: [0, 0], 3: [70000], 100: [1], 101: [3]}
    ids = {r.conv_id: [t.id for t in r.turns] for r in prefix_trie.turn_sequences(table).collect()}
    assert ids[1][1] == ids[1][2] and ids[2][0] == ids[2][1]
    empty = prefix_trie.turn_sequences(table.limit(0))
    assert empty.collect() == [] and prefix_trie.prefix_trie(rebranched(empty)).collect() == []


def test_rebranched(spark):
    rows = [(0, [turn(k) for k in range(7)]), (5, [turn(100)]), (17, [turn(200 + k) for k in range(8)]), (203, [turn(300 + k) for k in range(8)]), (300, [turn(1)])]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in rebranched(spark.createDataFrame(rows, SEQUENCES)).collect()}
    by = dict(rows)
    for c, turns in rows:
        h = zlib.crc32(str(c).encode()) % 6
        assert got[c] == by.get(c - c % 100, [])[:h] + turns[h:]
