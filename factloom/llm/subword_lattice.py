"""Language-model scores of documents: the probability of a text summed over all its segmentations into subwords."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import discard, in_small_batches, materialise, text_slices

#: Words known by heart in every task: the most frequent ones, as many at most, none longer in bytes.  All other words
#: are looked up by a join.
FREQUENT, FREQUENT_BYTES = 200_000, 64
#: Counts that a task adds up before it hands them on.
COUNTED = 400_000
#: Begins a word in the vocabulary; ends a text in it.
MARK, END = "▁", "</s>"
LOG10 = math.log(10)


def _words(text: bytes | None) -> list[bytes]:
    """Lower-cased in A-Z and cut at [\\x20\\x09-\\x0D], which is what bytes know of letters and blanks."""
    return text.lower().split() if text else []


def log_marginal(word: str, log: dict[str, float], longest: int) -> float:
    """Natural log of the probability of the word with its mark, summed over all segmentations into pieces: forward
    recursion in log space.  A character that is no piece is spelt in byte pieces."""
    s = MARK + word
    forward = [0.0]
    get, exp = log.get, math.exp
    for end in range(1, len(s) + 1):
        ways = [forward[start] + p for start in range(max(0, end - longest), end) if (p := get(s[start:end])) is not None]
        if s[end - 1] not in log:
            ways.append(forward[end - 1] + sum(log[f"<0x{b:02X}>"] for b in s[end - 1].encode()))
        if len(ways) == 1:
            forward.append(ways[0])
        else:
            most = max(ways, default=-math.inf)
            forward.append(most if most == -math.inf else most + math.log(sum([exp(w - most) for w in ways])))
    return forward[-1]


def vocabulary(path: str) -> tuple[list[str], list[float]]:
    """Pieces of a SentencePiece vocabulary and the weights that their scores give them: a score is the rank at which
    a piece was made, so a weight falls as 1 / rank; byte pieces, which have no score, come last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kept = [i for i in ids if not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i)]
    last = max(-model.get_score(i) for i in kept if not model.is_byte(i) and model.get_score(i) > -1e8)
    weights = [1 / (2 + (last if model.is_byte(i) else min(last, -model.get_score(i)))) for i in kept]
    return [model.id_to_piece(i) for i in kept], weights


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts in training rows (c) and in all rows (n), added up task by task."""
    def out(counts: Counter, learns: bool) -> pa.RecordBatch:
        n = pa.array(counts.values(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), n if learns else pa.array([0] * len(n), pa.int64()), n], names=["word", "c", "n"])

    counts = {True: Counter(), False: Counter()}
    for batch in batches:
        for text, learns in zip(batch.column("text").to_pylist(), batch.column("learns").to_pylist()):
            counts[learns].update(_words(text))
            if len(counts[learns]) > COUNTED:
                yield out(counts[learns], learns)
                counts[learns] = Counter()
    for learns, some in counts.items():
        if some:
            yield out(some, learns)


def _piece_counts(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, counts = sentencepiece.SentencePieceProcessor(model_file=path), Counter()
        for batch in batches:
            for pieces, c in zip(model.encode([w.decode() for w in batch.column("word").to_pylist()], out_type=str), batch.column("c").to_pylist()):
                for piece in pieces:
                    counts[piece] += c
        # a character without a piece comes back as itself here and is counted through its bytes
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], names=["piece", "c"])

    return count


def _word_logs(log: dict[str, float]):
    longest = max(map(len, log))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [log_marginal(w.decode(), log, longest) / LOG10 for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("word", "c", "n")], pa.array(logs, pa.float64())], names=["word", "c", "n", "log10"])

    return score


def piece_logs(counts: DataFrame, ends: int, path: str) -> dict[str, float]:
    """Natural-log probabilities of the pieces of the vocabulary at `path` and of `</s>`.

    Counts of the pieces in the vocabulary's own segmentation of the words of `counts` (word, c), with as many counts
    as there are pieces spread over all pieces by their ranks, so that none has a probability of 0."""
    pieces, weights = vocabulary(path)
    learnt = counts.where("c > 0").select("word", "c").mapInArrow(_piece_counts(path), "piece string, c long").groupBy("piece").agg(F.sum("c").alias("c"))
    known = F.broadcast(counts.sparkSession.createDataFrame([(p,) for p in pieces], "piece string"))
    seen = {r.piece: r.c for r in learnt.join(known, "piece").collect()}  # a row a piece of the vocabulary
    spread, total = len(pieces) / sum(weights), sum(seen.values()) + len(pieces) + ends + 1
    log = {p: math.log((seen.get(p, 0) + spread * w) / total) for p, w in zip(pieces, weights)}
    return log | {END: math.log((ends + 1) / total)}


def _frequent(words: DataFrame) -> dict[bytes, tuple[int, float]]:
    """The most frequent words with c and log10: all that reach a bound of n, set by a histogram of eighths of octaves
    so that they are FREQUENT at most."""
    octave = F.floor(F.log2("n") * 8)
    short = words.where(F.octet_length("word") <= FREQUENT_BYTES)
    found, least = 0, None
    for row in short.groupBy(octave.alias("o")).count().orderBy(F.col("o").desc()).collect():  # a few hundred rows
        found += row["count"]
        if found > FREQUENT:
            break
        least = row.o
    return {} if least is None else {bytes(r.word): (r.c, r.log10) for r in short.where(octave >= least).select("word", "c", "log10").collect()}


def _scored(frequent: dict[bytes, tuple[int, float]], least: float, id_type: pa.DataType):
    """A row for each document with what its frequent words give, word null; and one for each other word of it."""
    kinds = (pa.int64(), id_type, pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (math.log10(c + 1) - least, log10, c > 0) for w, (c, log10) in frequent.items()}
        for batch in text_slices(batches):
            rows = []
            for row, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "text")]):
                n = seen = 0
                base = model = 0.0
                for word, times in Counter(_words(text)).items():
                    n += times
                    if (of := known.get(word)) is None:
                        rows.append((row, None, word, times, None, None, None))
                    else:
                        base += times * of[0]
                        model += times * of[1]
                        seen += times * of[2]
                rows.append((row, doc_id, None, n, seen, base, model))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["row", "doc_id", "word", "times", "seen", "base", "model"])

    return score


def lattice_scores(docs: DataFrame, learns: Column, path: str) -> DataFrame:
    """Score every row of docs by a unigram model over the pieces of the vocabulary at `path`, learnt from the rows
    where `learns`; rows that are only to be scored are given with `learns` false.

    The words of all rows are counted, each word's probability is the sum over all its segmentations into pieces, by
    forward recursion in log space, once a word; a text's is the product over its words and one `</s>`.  Beside it
    stands the add-one unigram model over words.  Words that are frequent in the corpus, a list of bounded length, are
    added up where a text is read; every other word of a text meets its count and logarithm in a join on the word.
    Such a word has less than a FREQUENT-th of all words, so none is hot.  Nothing is sampled and no word is left out.

    Returns a row for each row: doc_id, n_tokens and n_known (with the end), train_tokens, base_score and score, both
    log10.  A null text counts as empty and has its end alone; a null `learns` counts as false; repeated rows and rows
    without a doc_id are scored each; without a training row the vocabulary's ranks alone are the model; an empty
    table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    text, learns = F.col("text").cast("binary").alias("text"), F.coalesce(learns, F.lit(False))
    counts = docs.select(text, learns.alias("learns")).mapInArrow(_counted, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    counts = materialise(counts, "lattice-counts")
    ends = docs.where(learns).count()
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)) + ends, F.count_if(F.col("c") > 0) + int(ends > 0)).first()
    log = piece_logs(counts, ends, path)
    words = materialise(counts.mapInArrow(_word_logs(log), "word binary, c long, n long, log10 double"), "lattice-words")
    discard(counts)
    least = math.log10(tokens + kinds + 1)
    id_type = docs.schema["doc_id"].dataType
    told = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text).mapInArrow(
        _scored(_frequent(words), least, to_arrow_type(id_type)), f"row long, doc_id {id_type.simpleString()}, word binary, times long, seen long, base double, model double")
    told = materialise(told, "lattice-rows")
    others = told.where(F.col("word").isNotNull()).join(words.select("word", "c", "log10"), "word").select(
        "row", "doc_id", F.lit(0).cast("long").alias("n"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("seen"),
        (F.col("times") * (F.log10(F.col("c") + 1) - least)).alias("base"), (F.col("times") * F.col("log10")).alias("model"))
    own = told.where(F.col("word").isNull()).select("row", "doc_id", F.col("times").alias("n"), "seen", "base", "model")
    sums = own.unionByName(others).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n", "seen", "base", "model")])
    return sums.select(
        "doc_id", (F.col("n") + 1).alias("n_tokens"), (F.col("seen") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + (math.log10(ends + 1) - least)).alias("base_score"), (F.col("model") + log[END] / LOG10).alias("score"))
