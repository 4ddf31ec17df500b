"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import MAX_REMEMBERED, bounded_sample, in_small_batches, materialise, text_slices, texts_of
from factloom.llm.quality import logistic

#: Documents that are learned from, at most about so many of either class; sentences used for fitting, and words and
#: stems of the lexicon that labels their tokens, at most.
MAX_TOXIC, MAX_CLEAN, MAX_SENTENCES, MAX_LEXICON = 3_000, 6_000, 4_000, 5_000
#: A word marks tokens of toxic documents as toxic if it is so many times more frequent there ...
ODDS = 20.0
#: ... and stands in this share of them at least, and in so many documents.
SHARE, LEAST = 0.004, 4
#: Tokens of a sequence: a sentence, or a part of one that is longer.
SEQUENCE = 64
SPAN_AT = 0.5
_WORD = re.compile(r"[^\W_]+")


def word_of(token: str) -> str:
    """Letters and digits of a token in lower case, so a word with digits for letters stays a word of its own."""
    return "".join(_WORD.findall(token.lower()))


STEMS = range(4, 9)
WIDTH = 5 + len(STEMS)


def features(word: str) -> list[str]:
    return ["bias", f"w={word}", f"p={word[:3]}", f"s={word[-3:]}", f"n={min(len(word), 12)}", *(f"p={word[:n]}" for n in STEMS if len(word) >= n)]


def marks_of(word: str) -> list[str]:
    """What may tell a toxic word: itself, or a stem that it begins with."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        found: Counter = Counter()
        for y, t in zip(b.column(b.schema.get_field_index("y")).to_pylist(), texts_of(b), strict=True):
            found.update((w, y) for w in {m for x in set(t.split()) for m in marks_of(word_of(x))} if w)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "y", "n"])


def sentences(tokens: list[str]) -> list[tuple[int, int]]:
    """Ranges of tokens: up to a token that ends in . ! or ?, SEQUENCE tokens at most."""
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t[-1] in ".!?" or i + 1 - start == SEQUENCE:
            out.append((start, i + 1))
            start = i + 1
    if start < len(tokens):
        out.append((start, len(tokens)))
    return out


def _sequences(lexicon: set[str]):
    """Training sentences with their token labels: all that hold a labelled token, and one in 64 of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            words, marks = [], []
            for y, t in zip(b.column(b.schema.get_field_index("y")).to_pylist(), texts_of(b), strict=True):
                tokens = t.split()
                for i, (x, z) in enumerate(sentences(tokens)):
                    w = [word_of(v) for v in tokens[x:z]]
                    m = [int(y == 1 and any(k in lexicon for k in marks_of(v))) for v in w]
                    if any(m) or (i % 64 == 0 and not (y == 1 and len(lexicon) == 0)):
                        words.append(w)
                        marks.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32())), pa.array([int(any(m)) for m in marks], pa.int32())], names=["words", "marks", "hit"])

    return run


def chain_odds(score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posterior odds that each token is toxic, by forward and backward ratios over all sequences side by side.

    score: log-potential of label 1 against 0 of all tokens in a row; starts, lengths: where sequences lie;
    trans[i, j]: potential of label j after label i.
    """
    psi = np.exp(np.clip(score, -25, 25))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    odds = np.empty(len(score))
    steps = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # sequences longer than t
    r = np.zeros(0)
    for t in range(steps):
        at = starts[: active[t]] + t
        before = r[: active[t]]
        r = psi[at] if t == 0 else psi[at] * (trans[0, 1] + before * trans[1, 1]) / (trans[0, 0] + before * trans[1, 0])
        odds[at] = r
    b = np.ones(0)
    for t in range(steps - 1, -1, -1):
        at = starts[: active[t]] + t
        ones = np.ones(active[t])
        if len(b):
            nxt = starts[: len(b)] + t + 1
            x = psi[nxt] * b
            ones[: len(b)] = (trans[1, 0] + trans[1, 1] * x) / (trans[0, 0] + trans[0, 1] * x)
        b = ones
        odds[at] *= b
    return odds


def fit_chain(words: list[list[str]], marks: list[list[int]], rounds: int = 60, l2: float = 1e-4) -> dict:
    """Maximum likelihood by gradient steps: expected feature counts come from forward and backward ratios."""
    seen = Counter(f for w in words for v in w for f in features(v))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 2))}
    if not words or not index:
        return {"index": {}, "w": np.zeros(0), "trans": np.ones((2, 2))}
    flat = [v for w in words for v in w]
    feats = np.full((len(flat), WIDTH), len(index))
    for i, v in enumerate(flat):
        f = [index[x] for x in features(v) if x in index]
        feats[i, : len(f)] = f
    y = np.array([m for s in marks for m in s], float)
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = np.ones(len(flat), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    w, a = np.zeros(len(index) + 1), np.zeros((2, 2))
    true_pairs = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4).reshape(2, 2)
    true_feats = np.bincount(feats.ravel(), weights=np.repeat(y, WIDTH), minlength=len(w))
    m1 = [np.zeros_like(w), np.zeros_like(a)]
    m2 = [np.zeros_like(w), np.zeros_like(a)]
    for k in range(1, rounds + 1):
        score = w[feats].sum(axis=1)
        odds = chain_odds(score, starts, lengths, np.exp(a))
        p = odds / (1 + odds)
        # pair marginals from single ones, through the conditional odds of the chain
        pairs = _pair_counts(score, starts, lengths, np.exp(a))
        grads = [(true_feats - np.bincount(feats.ravel(), weights=np.repeat(p, WIDTH), minlength=len(w))) / len(words) - l2 * w, (true_pairs - pairs) / len(words) - l2 * a]
        for j, (x, g) in enumerate(zip((w, a), grads, strict=True)):
            m1[j] = 0.9 * m1[j] + 0.1 * g
            m2[j] = 0.99 * m2[j] + 0.01 * g * g
            x += 0.2 * (m1[j] / (1 - 0.9**k)) / (np.sqrt(m2[j] / (1 - 0.99**k)) + 1e-8)
        w[-1] = 0.0
    return {"index": index, "w": w[:-1], "trans": np.exp(a)}


def _pair_counts(score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected numbers of label pairs of neighbours."""
    psi = np.exp(np.clip(score, -25, 25))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    steps = int(lengths[0])
    forward, backward = np.zeros(len(score)), np.ones(len(score))
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]
    for t in range(steps):
        at = starts[: active[t]] + t
        forward[at] = psi[at] if t == 0 else psi[at] * (trans[0, 1] + forward[at - 1] * trans[1, 1]) / (trans[0, 0] + forward[at - 1] * trans[1, 0])
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        x = psi[at + 1] * backward[at + 1]
        backward[at] = (trans[1, 0] + trans[1, 1] * x) / (trans[0, 0] + trans[0, 1] * x)
    first = np.ones(len(score), bool)
    first[starts] = False
    at = np.flatnonzero(first)
    f, x = forward[at - 1], psi[at] * backward[at]
    cells = np.stack([np.full(len(at), trans[0, 0]), trans[0, 1] * x, trans[1, 0] * f, trans[1, 1] * f * x], 1)
    return (cells / cells.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)


class Tokens(dict):
    """Row numbers of tokens in the table of their scores, remembered."""

    def __init__(self, model: dict):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.score, self.ends = np.zeros(1024), np.zeros(1024, bool)

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == len(self.score):
            self.score, self.ends = np.concatenate([self.score, self.score]), np.concatenate([self.ends, self.ends])
        index, w = self.model["index"], self.model["w"]
        self.score[at] = sum(w[index[f]] for f in features(word_of(token)) if f in index)
        self.ends[at] = token[-1] in ".!?"
        self[token] = at
        return at


def document_marginals(texts: list[str], tokens: Tokens, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic odds of all tokens of all texts in a row, and the texts' token counts."""
    ids, sizes = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        found = t.split()
        ids.append(np.fromiter(map(tokens.__getitem__, found), np.int64, len(found)))
        sizes[k] = len(found)
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    n = len(ids)
    if not n:
        return np.zeros(0), sizes
    begins = np.zeros(n, bool)
    begins[1:] = tokens.ends[ids[:-1]]
    begins[np.cumsum(sizes)[:-1][np.cumsum(sizes)[:-1] < n]] = True
    begins[0] = True
    starts = np.flatnonzero(begins)
    run = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    starts = np.flatnonzero(run % SEQUENCE == 0)
    lengths = np.diff(np.append(starts, n))
    return chain_odds(tokens.score[ids], starts, lengths, trans), sizes


def document_features(odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each document the log-odds of its most toxic token, of any toxic token, and the expected number of them."""
    x = np.tile([-12.0, -12.0, 0.0, 1.0], (len(sizes), 1))
    some = np.flatnonzero(sizes > 0)
    if len(some):
        at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        p = odds / (1 + odds)
        x[some, 0] = np.clip(np.log(np.maximum.reduceat(odds, at) + 1e-12), -12, 12)
        none = np.add.reduceat(np.log1p(odds), at)  # minus the log-probability that no token is toxic
        x[some, 1] = np.clip(np.log(np.expm1(np.minimum(none, 50)) + 1e-12), -12, 12)
        x[some, 2] = np.log1p(np.add.reduceat(p, at))
    return x


def _features_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for b in text_slices(batches):
            odds, sizes = document_marginals(texts_of(b), tokens, shared.value["trans"])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("y")).cast(pa.int32()), pa.array(list(document_features(odds, sizes)), pa.list_(pa.float64()))], names=["y", "x"])
            if len(tokens) > MAX_REMEMBERED:
                tokens.reset()

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on bounded samples of labelled documents.

    Token labels come from the document labels: a token of a toxic document is toxic if its word is ODDS times
    more frequent in toxic than in clean documents; every other token is not.  The chain is fitted on sentences,
    then a logistic regression turns a document's marginals into the probability of its label.  Rows without a
    label 0 or 1 are no labels; of differing labels of a document, or of equal texts, the larger counts.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    size = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = bounded_sample(known.where("y = 1"), "doc_id", MAX_TOXIC, size.get(1, 0), 3).unionByName(bounded_sample(known.where("y = 0"), "doc_id", MAX_CLEAN, size.get(0, 0), 3))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about MAX_TOXIC + MAX_CLEAN rows
    sample = materialise(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.min("text").alias("text")), "toxic-sample")
    total = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    counts = sample.mapInArrow(_document_words, "word string, y int, n long").groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    counts = counts.where((F.col("a") >= max(LEAST, SHARE * bad)) & ((F.col("a") + 0.5) / (bad + 1) >= ODDS * (F.col("b") + 0.5) / (good + 1)))
    lexicon = {r.word for r in counts.orderBy(F.col("a").desc(), "word").limit(MAX_LEXICON).collect()}
    drawn = sample.mapInArrow(_sequences(lexicon), "words array<string>, marks array<int>, hit int")
    rows = [r for hit in (1, 0) for r in drawn.where(F.col("hit") == hit).orderBy(F.xxhash64("words"), "words").limit(MAX_SENTENCES // 2).collect()]
    model = fit_chain([r.words for r in rows], [r.marks for r in rows])
    shared = spark.sparkContext.broadcast(model)
    scored = sample.mapInArrow(_features_of(shared), "y int, x array<double>").collect()
    x, y = np.array([r.x for r in scored]).reshape(len(scored), 4), np.array([r.y for r in scored], float)
    # classes were sampled at rates of their own
    if len(y) and y.min() < y.max():
        order = np.lexsort((*x.T, y))
        model["document"] = logistic(x[order], y[order])
        model["document"][-1] -= np.log((bad / max(1, size[1])) / (good / max(1, size[0])))
    else:
        model["document"] = np.array([0.0, 0.0, 0.0, 30.0 if len(y) and y[0] == 1 else -30.0])
    model["lexicon"] = sorted(lexicon)
    return model


def tag_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """Score every document and tag its toxic spans.

    Returns doc_id, score (0 to 1), spans array<struct<start, end, p>>: offsets in code points of neighbouring
    tokens whose marginals reach SPAN_AT, with the largest of these.  A null or empty text has no spans and the
    score of a text without any toxic token; empty tables give empty results; repeated rows are scored each;
    other columns are not read; long texts are cut into sentences and scored whole.
    """
    in_small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for b in text_slices(batches):
            texts = texts_of(b)
            odds, sizes = document_marginals(texts, tokens, shared.value["trans"])
            z = document_features(odds, sizes) @ shared.value["document"]
            hits, ends = np.flatnonzero(odds >= SPAN_AT / (1 - SPAN_AT)), np.cumsum(sizes)
            spans: list[list[dict]] = [[] for _ in texts]
            for doc in np.unique(np.searchsorted(ends, hits, side="right")):
                first = ends[doc] - sizes[doc]
                places = [m.span() for m in re.finditer(r"\S+", texts[doc])]
                last = -2
                for i in hits[(hits >= first) & (hits < ends[doc])] - first:
                    p = float(odds[first + i] / (1 + odds[first + i]))
                    if i == last + 1:
                        spans[doc][-1] |= {"end": places[i][1], "p": max(p, spans[doc][-1]["p"])}
                    else:
                        spans[doc].append({"start": places[i][0], "end": places[i][1], "p": p})
                    last = i
            if len(tokens) > MAX_REMEMBERED:
                tokens.reset()
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start int, end int, p double>>")
