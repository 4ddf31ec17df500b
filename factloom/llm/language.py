"""Language identification of mixed-language texts.

Script ranges narrow the languages that a word can be of; n-gram scores rank those that are left; Viterbi with a
penalty for every switch labels the words, so a text falls into spans of one language each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import MAX_REMEMBERED, broadcast_if_small, in_small_batches, text_slices, texts_of

#: Documents of each language that are learned from, at most about so many; the most frequent n-grams kept of them,
#: and numbers in the table of all languages by n-gram, which bounds the n-grams where there are many languages.
MAX_DOCUMENTS = 3_000
MAX_GRAMS, MAX_CELLS = 100_000, 12_000_000
#: What a switch of language costs, and the most that one word can count for or against a language.
SWITCH, WORD_CAP = 8.0, 5.0
#: A language is held to use a script if this share of its letters is in it.
SCRIPT_SHARE = 0.02

# First code point of a range and the script of its letters.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"),
    (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "other"),
    (0xFB50, "Arabic"), (0xFE00, "other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "other"), (0x20000, "Han"),
]
_STARTS = [s for s, _ in SCRIPTS]
_SCRIPT_ROWS = {name: k for k, (_, name) in reversed(list(enumerate(SCRIPTS)))}


def script(letter: str) -> int:
    """The row of SCRIPTS whose script a letter is of: the first row with that script's name."""
    return _SCRIPT_ROWS[SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]]


class Runs:
    """Runs of letters in lower case of many tokens at once, and the n-grams of one to three characters of each run
    with a space on either side.

    keys, run_of: a number for every n-gram and the run that it stands in; token_of, script_of: of every run the
    token and script; letters: of every token.
    """

    def __init__(self, tokens: list[str]):
        codes = np.frombuffer(("\n" + "\n".join(tokens) + "\n").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        known, place = np.unique(codes, return_inverse=True)
        chars = [chr(c) for c in known.tolist()]
        letter = np.array([c.isalpha() for c in chars])[place]
        token = np.cumsum(codes == 10) - 1
        codes = np.where(letter, codes, 32)
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        run = np.cumsum(begins) - 1
        self.token_of = token[begins]
        self.script_of = np.array([script(c) if c.isalpha() else -1 for c in chars])[place[begins]]
        self.letters = np.bincount(token[letter], minlength=len(tokens))[: len(tokens)]
        one = np.flatnonzero(letter)
        two = np.flatnonzero(letter[:-1] | letter[1:])
        self.keys = np.concatenate([codes[one], codes[two] | codes[two + 1] << 21, codes[one - 1] | codes[one] << 21 | codes[one + 1] << 42])
        self.run_of = np.concatenate([run[one], run[np.where(letter[two], two, two + 1)], run[one]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language the n-grams and scripts of its words, with their numbers."""
    for b in text_slices(batches):
        found: dict[str, Counter] = {}
        for lang, text in zip(b.column(b.schema.get_field_index("lang")).to_pylist(), texts_of(b), strict=True):
            found.setdefault(lang, Counter()).update(text.split())
        for lang, words in found.items():
            if not words:
                continue
            runs, times = Runs(list(words)), np.array(list(words.values()))
            keys, at = np.unique(runs.keys, return_inverse=True)
            n = np.bincount(at, weights=times[runs.token_of[runs.run_of]], minlength=len(keys))
            own = np.bincount(runs.script_of, weights=(runs.letters * times)[runs.token_of], minlength=len(SCRIPTS)) if len(runs.script_of) else np.zeros(len(SCRIPTS))
            scripts = np.flatnonzero(own)
            size = len(keys) + len(scripts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.concatenate([keys, scripts]), pa.int64()), pa.array(np.arange(size) >= len(keys)), pa.array(np.concatenate([n, own[scripts]]).astype(np.int64))], names=["lang", "gram", "is_script", "n"])


def fit_languages(docs: DataFrame) -> dict:
    """Learn n-gram and script counts of every language from a bounded sample of its documents; only the counts of
    MAX_GRAMS n-grams, or fewer under MAX_CELLS, reach the driver.  Rows with a null language or text, and languages
    without any letter, teach nothing."""
    in_small_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    known = known.join(broadcast_if_small(sizes, sizes.count()), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) * F.col("_n") < F.lit(1_000_000 * MAX_DOCUMENTS)).select("text", "lang")
    counts = known.mapInArrow(_count, "lang string, gram long, is_script boolean, n long").groupBy("is_script", "gram", "lang").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("is_script", "gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    scripts = counts.where("is_script").collect()
    langs = sorted({k for r in scripts for k in r["by"]})
    if not langs:
        return {"langs": []}
    rows = counts.where("NOT is_script AND all >= 3").orderBy(F.col("all").desc(), "gram").limit(min(MAX_GRAMS, max(1, MAX_CELLS // len(langs)))).collect()
    letters = Counter()
    for r in scripts:
        letters.update(r["by"])
    uses = np.zeros((len(SCRIPTS), len(langs)), bool)
    for r in scripts:
        uses[r["gram"]] = [r["by"].get(x, 0) >= SCRIPT_SHARE * letters[x] for x in langs]
    rows.sort(key=lambda r: r["gram"])
    n = np.array([[r["by"].get(x, 0) for x in langs] for r in rows], float).reshape(len(rows), len(langs))
    table = np.log((np.vstack([n, np.zeros(len(langs))]) + 0.5) / (n.sum(axis=0) + 0.5 * (len(rows) + 1)))
    return {"langs": langs, "grams": np.array([r["gram"] for r in rows], np.int64), "table": table, "uses": uses}


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels of the best path, where staying is free and every switch costs `switch`."""
    n, k = scores.shape
    best, froms, jumps = [0.0] * k, [], []
    for row in scores.tolist():
        top = max(best)
        at = best.index(top)
        low = top - switch
        jumped = [b < low for b in best]
        best = [(low if j else b) - top + s for b, j, s in zip(best, jumped, row, strict=True)]
        froms.append(at)
        jumps.append(jumped)
    label = best.index(max(best))
    path = np.empty(n, np.int64)
    for t in range(n - 1, -1, -1):
        path[t] = label
        if jumps[t][label]:
            label = froms[t]
    return path


def label_words(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels, by a shortcut where it is certain.

    Measured against the language of the highest total: if no run of words gains more than the penalty in any
    other language, and the best beginning and the best end together don't either, every path with switches
    loses at least what it gains, and that language is the answer at once.
    """
    total = scores.sum(axis=0)
    best = int(np.argmax(total))
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low = np.vstack([np.zeros((1, scores.shape[1])), low[:-1]])
    if (gain - low).max() <= switch and max(0.0, gain.max()) + max(0.0, (gain[-1] - np.minimum(gain.min(axis=0), 0)).max()) <= switch:
        return np.full(len(scores), best)
    return viterbi(scores, switch)


class Words(dict):
    """Row numbers of words in the table of their scores, remembered."""

    def __init__(self, model: dict):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.scores, self.letters = np.zeros((0, len(self.model["langs"]))), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Score words that are not known yet, all of them at once."""
        words = [w for w in dict.fromkeys(words) if w not in self]
        if not words:
            return
        runs, grams, table = Runs(words), self.model["grams"], self.model["table"]
        n, langs = len(runs.token_of), range(len(self.model["langs"]))
        row = np.minimum(np.searchsorted(grams, runs.keys), max(0, len(grams) - 1))
        row = np.where(grams[row] == runs.keys, row, len(grams)) if len(grams) else np.zeros(len(runs.keys), np.int64)
        s = np.stack([np.bincount(runs.run_of, weights=table[row, k], minlength=n) for k in langs], axis=1)
        allowed = self.model["uses"][runs.script_of]
        told = allowed.any(axis=1)  # a script that no known language uses tells nothing
        s = np.where(allowed, s, -np.inf)
        s[~told] = 0
        s = np.maximum(s - s.max(axis=1, keepdims=True), -WORD_CAP)
        scores = np.stack([np.bincount(runs.token_of, weights=s[:, k], minlength=len(words)) for k in langs], axis=1)
        at = len(self)
        self.update(zip(words, range(at, at + len(words)), strict=True))
        self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, runs.letters])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Label every document and its spans.

    Returns doc_id, lang_pred, score, spans array<struct<start, end, lang>> (code points; they cover the text).
    lang_pred is the language of most letters, score their share times the probability of that language against
    the next best; 'und' with score 0 and no spans where a text is null or has no letter, or nothing was learned.
    Empty tables give empty results; repeated rows are labelled each; other columns are not read; ties go to the
    language that sorts first.
    """
    in_small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value["langs"]
        words = Words(shared.value)
        for b in text_slices(batches):
            pred, score, spans = [], [], []
            if len(words) > MAX_REMEMBERED:
                words.reset()
            texts = texts_of(b)
            split = [t.split() for t in texts]
            if langs:
                words.learn([w for found in split for w in found])
            for text, found in zip(texts, split, strict=True):
                ids = np.fromiter(map(words.__getitem__, found), np.int64, len(found)) if langs else np.zeros(0, np.int64)
                used = np.flatnonzero(words.letters[ids] > 0) if len(ids) else ids
                if not len(used):
                    pred.append("und")
                    score.append(0.0)
                    spans.append([])
                    continue
                s = words.scores[ids[used]]
                path = label_words(s)
                share = np.bincount(path, weights=words.letters[ids[used]], minlength=len(langs))
                top = int(np.argmax(share))
                total = s.sum(axis=0)
                rest = np.delete(total, top)
                sure = 1 / (1 + math.exp(-max(-30.0, min(30.0, total[top] - rest.max())))) if len(rest) else 1.0
                pred.append(langs[top])
                score.append(float(share[top] / share.sum() * sure))
                cuts = np.flatnonzero(np.diff(path)) + 1
                if len(cuts):
                    starts = [m.start() for m in re.finditer(r"\S+", text)]
                    edges = [0, *(starts[used[c]] for c in cuts), len(text)]
                else:
                    edges = [0, len(text)]
                spans.append([{"start": x, "end": y, "lang": langs[path[c]]} for x, y, c in zip(edges, edges[1:], [0, *cuts], strict=False)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start int, end int, lang string>>")
