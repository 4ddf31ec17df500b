"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factloom.llm.common import bounded_sample, in_small_batches, text_slices, texts_of

#: Labelled and unlabelled rows used for fitting, at most about so many; every other row is only scored.
MAX_LABELLED = 20_000
MAX_UNLABELLED = 20_000
SOURCE_SLOTS, LANG_SLOTS, WORD_SLOTS = 64, 16, 64
BYTE_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?", "#$%&*@^~+=", "|<>{}[]\\_", ".,;:'\"()-", " \t", "\n\r")
N_TEXT = 2 * (len(BYTE_CLASSES) + 8) + WORD_SLOTS + 1
N_META = SOURCE_SLOTS + LANG_SLOTS + 24


#: Words of which a Python worker remembers the slot.
MAX_SLOTS = 30_000


class WordSlots(dict):
    """The slot of a word in lower case, by a hash of it, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_SLOTS:
            self.clear()
        k = self[word] = zlib.crc32(word.lower().encode()) % WORD_SLOTS
        return k


_SLOTS = WordSlots()


def text_features(text: str) -> np.ndarray:
    """Shares of character classes and of repetition in a whole text, each also as its square root, and the square
    roots of the shares of its words by slot."""
    raw = text.encode("utf-8")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    size = max(1, len(raw))
    shares = [counts[np.frombuffer(c.encode(), np.uint8)].sum() / size for c in BYTE_CLASSES]
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    seen = Counter(words)
    most = max(seen.values(), default=0)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = max(1, counts[65:91].sum() + counts[97:123].sum())
    shares += [counts[128:].sum() / size, counts[65:91].sum() / letters, len(seen) / n, most / n, again / n, len(set(lines)) / len(lines), min(1.0, len(words) / size * 4), min(1.0, np.log1p(len(raw)) / 15)]
    x = np.array(shares)
    slots = np.bincount(np.fromiter(map(_SLOTS.__getitem__, seen), np.int64, len(seen)), weights=np.fromiter(seen.values(), float, len(seen)), minlength=WORD_SLOTS)
    return np.concatenate([x, np.sqrt(x), np.sqrt(slots / n), [1.0]])


def meta_slots(source, lang, n_chars) -> tuple[int, int, int]:
    """Positions that are 1 in the metadata view: source, language and size class."""
    return (
        zlib.crc32(str(source).encode()) % SOURCE_SLOTS,
        SOURCE_SLOTS + zlib.crc32(str(lang).encode()) % LANG_SLOTS,
        SOURCE_SLOTS + LANG_SLOTS + min(22, int(np.log2(1 + max(0, n_chars or 0)))),
    )


def meta_features(rows: list[tuple]) -> np.ndarray:
    x = np.zeros((len(rows), N_META), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, list(meta_slots(*r))] = 1
    return x


#: Rows of which a step of the fit makes double-precision copies at once.
CHUNK = 4096


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Newton's method for a logistic regression; its sums go over chunks of rows, so x may stay in single precision."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        curve, slope = l2 * len(x) * np.eye(len(w)), -l2 * len(x) * w
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK].astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve += (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
            slope += part.T @ (y[at : at + CHUNK] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def co_train(text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, text_u: np.ndarray, meta_u: np.ndarray, rounds: int = 4, sure: float = 0.95) -> dict:
    """Two views teach each other.

    In each round either view's classifier labels those unlabelled rows of which it is sure, as many of each class
    as its share among the labels allows, and hands them to the other view's training rows.  A third of the
    labelled rows stays out of both and calibrates each view and their combination.
    """
    if len(y) == 0 or y.min() == y.max():
        constant = float(y[0]) if len(y) else 0.5
        return {"constant": constant}
    held = np.arange(len(y)) % 3 == 2
    if held.sum() == 0 or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    views = {"text": (text_x[~held], text_u), "meta": (meta_x[~held], meta_u)}
    own = {k: y[~held] for k in views}
    train = {k: v[0] for k, v in views.items()}
    share, size = own["text"].mean(), max(10, len(text_u) // (2 * rounds))
    for _ in range(rounds):
        given = {}
        for k, (_, pool) in views.items():
            w = logistic(train[k], own[k])
            p = 1 / (1 + np.exp(-np.clip(pool @ w, -30, 30)))
            up, down = np.argsort(-p, kind="stable")[: int(size * share) + 1], np.argsort(p, kind="stable")[: int(size * (1 - share)) + 1]
            up, down = up[p[up] >= sure], down[p[down] <= 1 - sure]
            given[k] = np.concatenate([up, down]).astype(int), np.concatenate([np.ones(len(up)), np.zeros(len(down))])
        for k, other in (("text", "meta"), ("meta", "text")):
            rows, labels = given[other]
            train[k] = np.concatenate([views[k][0], views[k][1][rows]])
            own[k] = np.concatenate([y[~held], labels])
    model = {k: logistic(train[k], own[k]) for k in views}
    tx, mx, ty = (text_x[held], meta_x[held], y[held]) if held.any() else (text_x, meta_x, y)
    for k, x in (("text", tx), ("meta", mx)):
        model[f"{k}_scale"] = logistic(np.stack([x @ model[k], np.ones(len(x))], 1), ty)
    model["both"] = logistic(np.stack([*_logits(model, tx, mx).T, np.ones(len(ty))], 1), ty)
    return model


def _logits(model: dict, text_x: np.ndarray, meta_x: np.ndarray) -> np.ndarray:
    """Calibrated log-odds of the two views."""
    a, b = text_x @ model["text"], meta_x @ model["meta"]
    return np.stack([model["text_scale"][0] * a + model["text_scale"][1], model["meta_scale"][0] * b + model["meta_scale"][1]], 1)


def predict(model: dict, text_x: np.ndarray, meta_x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(text_x), model["constant"])
    z = np.stack([*_logits(model, text_x, meta_x).T, np.ones(len(text_x))], 1) @ model["both"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_VIEW = "y int, t binary, source string, lang string, n_chars long"


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        x = [text_features(t).astype(np.float32).tobytes() for t in texts_of(b)]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("y")).cast(pa.int32()), pa.array(x, pa.binary()), *[b.column(b.schema.get_field_index(c)).cast(t) for c, t in (("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()))]], names=["y", "t", "source", "lang", "n_chars"])


def fit_quality(docs: DataFrame, labels: DataFrame, rounds: int = 4) -> dict:
    """Fit on bounded samples of labelled and unlabelled documents; only their features reach the driver.

    Rows without a label 0 or 1 are no labels; of repeated labels of a document the larger counts; where all labels
    are alike every document scores that, and 0.5 where there is none.  Rows that are equal in all features may stand
    in any order, so the fit does not depend on how rows were dealt over tasks.
    """
    in_small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    known = bounded_sample(known, "doc_id", MAX_LABELLED, seed=11)
    cols = ["doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")]
    labelled = docs.select(*cols).join(F.broadcast(known), "doc_id").drop("doc_id")  # about MAX_LABELLED rows at most
    pool = bounded_sample(docs.select(*cols), "doc_id", MAX_UNLABELLED, docs.count(), seed=13).join(F.broadcast(known), "doc_id", "left_anti").select("text", "source", "lang", "n_chars", F.lit(-1).alias("y"))
    rows = labelled.unionByName(pool).mapInArrow(_views, _VIEW).toPandas()
    rows["n_chars"] = rows["n_chars"].fillna(-1)
    rows = rows.sort_values(["t", "y", "source", "lang", "n_chars"], kind="stable")  # the same order whichever task came first
    text, meta = np.frombuffer(b"".join(rows["t"]), np.float32).reshape(len(rows), N_TEXT), meta_features(list(zip(rows["source"], rows["lang"], rows["n_chars"], strict=True)))
    y = rows["y"].to_numpy().astype(float)
    del rows
    return co_train(text[y >= 0], meta[y >= 0], y[y >= 0], text[y < 0], meta[y < 0], rounds)


def score_quality(docs: DataFrame, model: dict, name: str = "quality_score") -> DataFrame:
    """All columns of docs and a score from 0 to 1, higher for better documents.

    A null text counts as empty, null metadata as values of their own; an empty table gives an empty result;
    repeated rows are scored each; a column of docs that is called like the score is replaced.
    """
    in_small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            at = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            x = np.array([text_features(t) for t in texts_of(b)]).reshape(b.num_rows, N_TEXT)
            meta = meta_features(list(zip(*[at[c].to_pylist() for c in ("source", "lang", "n_chars")], strict=True)))
            yield pa.RecordBatch.from_arrays([*[at[f.name] for f in kept], pa.array(predict(shared.value, x, meta), pa.float64())], names=[*[f.name for f in kept], name])

    return docs.select(*[f.name for f in kept]).mapInArrow(score, StructType([*kept, StructField(name, DoubleType())]))
