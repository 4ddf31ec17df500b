"""Brute-force comparisons and edge cases: content sort, MinHash, mixing, byte-level BPE, quality, pipeline."""

import hashlib
import itertools
import re
from pathlib import Path

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import byte_bpe, content_sort, mixing, near_dup, quality
from factloom.llm.common import shared_dir, table
from factloom.llm.queries import MIX_WEIGHTS, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, band int, _norm string"


def rows(*texts):
    return [(i if t != "null-id" else None, t, "en", "src1", len(t) if t else None, "x", 1, "y") for i, t in enumerate(texts)]


ODD = [None, "", " ", "a", "a ", "A", "a ", "one two", "one  two", "w " * 30000, "x" * 70000, "null-id", "same text here", "same text here", "same  text here", "\U0001f600 ́"]


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs, percent):
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def brute_copies(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d))
    return {n: (sorted(g, key=lambda x: (x[0], x[1], x[2] or 0))[0][2], len(g)) for n, g in groups.items()}


def test_hot_text_without_ids(spark):
    docs = spark.createDataFrame([(None if k % 5 else k, "same " * (1 + k % 2), "z") for k in range(3000)], "doc_id long, text string, kept string")
    got = content_sort.content_sort_dedup(docs).groupBy("keep_id", "group_size").agg({"*": "count"}).collect()
    assert [tuple(r) for r in got] == [(0, 1500, 1500), (5, 1500, 1500)] or sorted(map(tuple, got)) == [(0, 1500, 1500), (5, 1500, 1500)]
    assert content_sort.content_sort_dedup(docs).where("kept").count() == 2


@pytest.mark.parametrize("hot", [False, True])
def test_content_sort_matches_brute_force(spark, hot):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    docs += [(r[0], r[1]) for r in [(90000 + i, t) for i, t in enumerate(ODD)]] + [(None, "a"), (7, None)]
    if hot:
        docs += [(100_000 + i, "hot  text" + " " * (i % 3)) for i in range(700)]
    df = spark.createDataFrame([(d, t, "z", 5) for d, t in docs], "doc_id long, text string, kept string, _norm int")
    want, got = brute_copies(docs), content_sort.content_sort_dedup(df).collect()
    assert len(got) == len(docs)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): v for n, v in want.items()}
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert content_sort.distinct_documents(df).count() == len(want)
    assert content_sort.distinct_documents(df).columns == df.columns


def test_near_duplicates_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(80)]
    for k in range(40):  # a chain and a star of near copies around the threshold
        w = list(base)
        for j in rng.choice(80, k % 5, replace=False):
            w[j] = f"other{k}"
        docs.append((5000 + k, " ".join(w)))
    docs += [(9000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in docs], "doc_id long, text string, a int, band string")
    for percent in (85, 80):
        want = brute_components(docs, percent)
        got = near_dup.near_duplicates(df, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_bands_of_several_components(spark, monkeypatch):
    """A hot set, a hub with many links and bands of many members and outsiders, in blocks of a few members."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "SIGNATURE_BLOCK", 11)
    monkeypatch.setattr(near_dup, "MEMBERS", 20)
    rng = np.random.default_rng(5)
    docs = [(k, "one two three four five six seven") for k in range(400)]
    base = [f"w{k}" for k in range(60)]
    for k in range(260):  # near copies of one text, and texts that are less and less like it
        w = list(base)
        for j in rng.choice(60, int(rng.integers(0, 3)) if k % 3 else int(rng.integers(2, 5)), replace=False):
            w[j] = f"o{k}" if k % 2 else f"o{j}"
        docs.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 80).collect()}
    assert got == brute_components(docs, 80)


def test_near_duplicates_odd_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "x y"), (2, "x y"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [(-1, None, True) if r[0] == -1 else r for r in got] and {r[1] for r in got if r[0] in (1, 2)} == {1}
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        found = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            y = np.concatenate([x[: int(400 * share)], rng.integers(0, 1 << 63, 400 - int(400 * share), dtype=np.uint64)])
            a, b = near_dup.signature(x)[0].view(np.uint64), near_dup.signature(y)[0].view(np.uint64)
            z = a ^ b
            unequal = sum(bin(int(v)).count("1") for v in (z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555))
            found.append(((1 - unequal / 128) - 0.25) / 0.75)
        n = int(400 * share)
        assert abs(np.mean(found) - n / (800 - n)) < 0.04


@pytest.fixture(scope="module")
def bpe():
    path, pattern = tokenizer()
    own = byte_bpe.ByteBPE(byte_bpe.read_ranks(path), pattern)
    return own, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="etaoin shrdlu'ED\n\t  .,!é \x1c", max_size=200)))
def test_bpe_equals_tiktoken(bpe, text):
    own, other = bpe
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_over_documents(spark, bpe):
    df = table(spark, SF, "documents").select("doc_id", "text").union(spark.createDataFrame([(90000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = {r.doc_id: r for r in byte_bpe.encode_digests(df, *tokenizer()).collect()}
    for r in df.collect():
        ids = np.array(bpe[1].encode_ordinary(r.text or ""), "<u4")
        x = got[r.doc_id]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert byte_bpe.encode_documents(df.limit(0), *tokenizer()).collect() == []


def test_bpe_over_all_letters(bpe):
    """Letters and numbers of any version of Unicode, and every seventh other code point, in two surroundings."""
    own, other = bpe
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = [c for k, c in enumerate(points) if k % 7 == 0 or not 0x3400 < ord(c) < 0xD7A4 and regex.match(r"[\p{L}\p{N}\s]", c)]
    for at in range(0, len(points), 5000):
        text = "\n".join(f"a{c}1 {c}{c} 1{c} X{c}'s" for c in points[at : at + 5000])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)


@pytest.mark.parametrize("pattern", [r"\S+(?: \S+)?|\s+", r"\p{N}{1,3}|[^\r\n\p{L}\p{N}]?\p{L}+|\s+|.", r"(?i:'s|'t)|\w+|\W"])
def test_bpe_with_other_patterns(bpe, pattern):
    ranks = bpe[0].ranks
    own, other = byte_bpe.ByteBPE(ranks, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("of the in a", "it's  a Test 12345 \u7ae5 x", "a\n b", "1\ua7ce2 X's"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def plain_budgets(capacity, weights, total):
    """Hierarchical budgets by filling siblings round by round, apart from the operator's own way."""
    below, holds, budget = {}, {}, {}
    for leaf, tokens in capacity.items():
        if any(weights.get(leaf[:d], 1.0) <= 0 for d in range(1, len(leaf) + 1)):
            tokens = 0
        for depth in range(len(leaf), -1, -1):
            holds[leaf[:depth]] = holds.get(leaf[:depth], 0) + tokens
            if depth:
                below.setdefault(leaf[: depth - 1], {})[leaf[:depth]] = None

    def settle(node, amount):
        if node not in below:
            budget[node] = amount
            return
        share, left, open_ = dict.fromkeys(below[node], 0), amount, sorted(below[node])
        while left > 0 and open_:
            own = {c: max(0.0, weights.get(c, 1.0)) for c in open_}
            if sum(own.values()) <= 0:
                break
            asked = {c: left * own[c] / sum(own.values()) for c in open_}
            full = [c for c in open_ if asked[c] >= holds[c]]
            if not full:
                whole = {c: int(asked[c]) for c in open_}
                for c in sorted(open_, key=lambda c: (-(asked[c] - whole[c]), c))[: left - sum(whole.values())]:
                    whole[c] += 1
                for c in open_:
                    share[c] = min(whole[c], holds[c])
                break
            for c in full:
                left -= holds[c]
                share[c] = holds[c]
            open_ = [c for c in open_ if c not in full]
        for c in below[node]:
            settle(c, share[c])

    if capacity:
        settle((), min(total, holds[()]))
    return budget


def budgets(spark, cap, weights, total):
    df = spark.createDataFrame([(*k, v) for k, v in cap.items()], "a string, b string, c string, holds long")
    return {tuple(r[:3]): r._budget for r in mixing.plan_budgets(df, ["a", "b", "c"], "holds", weights, total).collect()}


def test_budgets(spark):
    # b cannot take its half: the sibling a takes it before x does
    cap = {("r", "n", "a"): 100, ("r", "n", "b"): 10, ("r", "x", "c"): 100}
    assert budgets(spark, cap, {}, 120) == {("r", "n", "a"): 50, ("r", "n", "b"): 10, ("r", "x", "c"): 60}
    assert budgets(spark, cap, {}, 500) == cap
    assert budgets(spark, {}, {}, 5) == {}
    assert budgets(spark, cap, {("r", "n"): 0.0}, 90) == {("r", "n", "a"): 0, ("r", "n", "b"): 0, ("r", "x", "c"): 90}
    rng = np.random.default_rng(9)
    for k in range(12):
        cap = {(str(a), str(b), str(c)): int(rng.integers(0, 60)) for a, b, c in rng.integers(0, 6, (60, 3))}
        weights = {("1",): 3.0, ("1", "2"): 0.5, ("3",): 0.0, ("2", "2", "1"): -1.0} if k % 2 else {}
        total = int(rng.integers(0, 2 * sum(cap.values())))
        got = budgets(spark, cap, weights, total)
        assert got == plain_budgets(cap, weights, total)
        dead = sum(v for x, v in cap.items() if any(weights.get(x[:d], 1) <= 0 for d in (1, 2, 3)))
        assert sum(got.values()) == min(total, sum(cap.values()) - dead)


def test_many_leaves_and_weight_zero(spark, monkeypatch):
    """More leaves than may be broadcast, one of them with most documents, and a source of weight 0 with empty texts."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 10)
    docs = [(k, "x" * (k % 9), "en", f"src{k % 50 if k % 3 else 0}") for k in range(1500)]
    docs += [(5000 + k, "" if k < 180 else "word", "en", "bad4") for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    weights = {("d0", "en", "bad4"): 0.0}
    got = sorted((r.doc_id, r.mix_epoch, r.mix_tokens) for r in mixing.mix(df, weights, fraction=0.7).collect())
    assert got == brute_mix(docs, weights, 0.7, 1, mixing.DEFAULT_SEED) and max(d for d, _, _ in got) < 5000


def brute_mix(docs, weights, fraction, epochs, seed):
    def domain(s):
        m = re.search(r"[0-9]+$", s or "")
        return f"d{int(m[0]) % 4}" if m else "other"

    leaves = {}
    for d, text, lang, source in docs:
        leaves.setdefault((domain(source), lang or "", source or ""), []).append((d, -(-len(text or "") // 4)))
    once = {k: sum(t for _, t in v) for k, v in leaves.items()}
    budget = plain_budgets({k: v * epochs for k, v in once.items()}, weights, int(sum(once.values()) * fraction))
    out = []
    for k, v in leaves.items():
        if any(weights.get(k[:d], 1) <= 0 for d in (1, 2, 3)) or (once[k] and not budget[k]):
            continue
        used = 0
        order = [(e, hashlib.md5(f"{seed}:{e}:{d}".encode()).hexdigest(), d, t) for e in range(epochs) for d, t in v]
        for e, _, d, t in sorted(order):
            if used + t > budget[k]:
                break
            used += t
            out.append((d, e, t))
    return sorted(out)


@pytest.mark.parametrize(("fraction", "epochs"), [(0.6, 1), (0.9, 2), (1.4, 2)])
def test_mixing_matches_brute_force(spark, fraction, epochs):
    df = table(spark, SF, "documents")
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    docs += [(70000, None, None, None), (70001, "abc", "en", "nowhere")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, source string, mix_tokens int")
    got = sorted((r.doc_id, r.mix_epoch, r.mix_tokens) for r in mixing.mix(df, MIX_WEIGHTS, fraction=fraction, max_epochs=epochs).collect())
    assert got == brute_mix(docs, MIX_WEIGHTS, fraction, epochs, mixing.DEFAULT_SEED)
    assert mixing.mix(df.limit(0)).collect() == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit_quality(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.q for r in quality.score_quality(docs, model, "q").select("doc_id", "q").collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.where("doc_id % 3 = 1").collect()]
    right = [(s >= 0.5) == (y == 1) for s, y in held]
    assert np.mean(right) > 0.93
    odd = spark.createDataFrame(rows(*ODD), SCHEMA)
    assert quality.score_quality(odd, model, "kept").count() == len(ODD)
    assert quality.score_quality(odd.limit(0), model).count() == 0
    empty = quality.fit_quality(docs.limit(0), labels.limit(0))
    assert {r.quality_score for r in quality.score_quality(odd, empty).collect()} == {0.5}


def test_pipeline_stages_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = SF
    docs = table(spark, sf, "documents")
    kept = pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    a = kept.collect()
    exact = pipeline.exact_stage(spark, kept, sf)
    want = brute_copies([(r.doc_id, r.text) for r in a])
    assert sorted(r.doc_id for r in exact.collect()) == sorted(v[0] for v in want.values())
    b = [(r.doc_id, r.text) for r in exact.collect()]
    near = pipeline.near_stage(spark, exact, sf)
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, (_, c) in brute_components(b, 80).items() if c == d)
    c = [(r.doc_id, r.text, r.lang, r.source) for r in near.collect()]
    mixed = pipeline.mixing_stage(spark, near, sf)
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.collect()) == [d for d, _, _ in brute_mix(c, MIX_WEIGHTS, 0.9, 1, mixing.DEFAULT_SEED)]
    base = Path(shared_dir(spark).removeprefix("file:"))
    stages = lambda: {p.name for p in base.glob("stage-*")}
    before = stages()
    assert pipeline.run(spark, sf).count() == mixed.count()
    # earlier stages are deleted once the next one stands
    assert [n.split("-")[1] for n in stages() - before] == ["4"]
