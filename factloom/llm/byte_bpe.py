"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that one Aho-Corasick automaton over the whole vocabulary finds, in one
pass, the longest token at every byte of a piece.  Encoding walks from longest match to longest match; a token
may follow another only if byte-pair merging of the two together gives those two again.  That test is memoised.
A dead end falls back to the next shorter token, and a position once found dead is never entered again, so each
byte is handled a bounded number of times and the result equals that of applying the merges by rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import MAX_REMEMBERED, in_small_batches, text_slices, texts_of

#: Ranks files up to this size are broadcast; a vocabulary is a fixed parameter and does not grow with the data.
MAX_RANKS_BYTES = 64 << 20

# Fixed value: the pattern for which texts are cut at single spaces and words remembered apart.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters and numbers that came after version 16 of Unicode, whose tables decide what \p{L} and \p{N} are.
NEWER_LETTERS = r"\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C\uAB6D" + r"""
\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3
\U00016FF2\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168
\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4\U0001E6E5\U0001E6E7-\U0001E6ED
\U0001E6F0-\U0001E6F4\U0001E6FE\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F""".replace("\n", "")
#: The first code point of them; texts below it need no dated tables.
FIRST_NEWER = "\u0558"
NEWER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with \\p{L} and \\p{N} as of version 16 of Unicode, whatever tables the regex module has."""
    dated = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEWER_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEWER_NUMBERS}]]")
    return regex.compile(dated, regex.VERSION1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}


class ByteBPE:
    """Encoder and decoder for one table of ranks and one pattern of pieces.

    Any pattern is applied match by match; texts are cut at single spaces first only under SPACED_PATTERN, of which
    this is known to change nothing.  Groups of the pattern must not capture.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.dated, self.plain = compile_pattern(pattern), regex.compile(pattern)
        self.spaced = pattern == SPACED_PATTERN
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        words = ahocorasick.Automaton()
        for token, rank in ranks.items():
            words.add_word(token.decode("latin-1"), rank)
        words.make_automaton()
        self.words = words
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.reach = max(self.length.values())
        self.shorter = {rank: self._longest_proper_prefix(token) for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.token_bytes):
            self.halves[rank] = self._split(rank)
        self.fits.clear()  # answers given while the table was growing may lack later merges
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.token_bytes}
        self.remembered: dict[str, bytes] = {}  # parts, as they stand after a space
        self.older: dict[str, bytes] = {}  # parts, as they stand after a space
        self.remembered_pieces: dict[str, bytes] = {}

    def _longest_proper_prefix(self, token: bytes) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return None

    def _split(self, rank: int) -> tuple[int, int]:
        """The last merge that makes a token, or the token twice if none does (single bytes)."""
        token, left = self.token_bytes[rank], self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[len(self.token_bytes[left]) :])
            if right is not None and left < rank and right < rank and self._compatible(left, right):
                self.merged[left, right] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a boundary between the two.

        The merges on both sides of the boundary are undone from the latest back.  If at any moment the two
        tokens that touch the boundary had a merge of their own that came before the step just undone, that
        merge would have crossed the boundary.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        before, found = 1 << 62, True  # merges of a lower rank than this happen first
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < before:
                found = False
                break
            if left > right:
                before, (_, inner) = left, self.halves[left]
                if inner != left:
                    left = inner
                    continue
                if (outer := self.halves[right][0]) == right:
                    break
                before, right = right + 1, outer
            else:
                before, outer = right + 1, self.halves[right][0]
                if outer != right:
                    right = outer
                    continue
                if (inner := self.halves[left][1]) == left:
                    break
                before, left = left, inner
        self.fits[key] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text = piece.decode("latin-1")
        longest_matches, length, shorter, fits, compatible = self.words.iter_long, self.length, self.shorter, self.fits, self._compatible
        ids: list[int] = []
        for _, token in longest_matches(text):
            if ids and not (fits[pair] if (pair := (ids[-1], token)) in fits else compatible(*pair)):
                break
            ids.append(token)
        else:
            return ids
        at, size, reach, dead = sum(map(length.__getitem__, ids)), len(text), self.reach, set()
        token = shorter[token]
        while True:
            while token is not None:
                end = at + length[token]
                if end not in dead and (not ids or (fits[pair] if (pair := (ids[-1], token)) in fits else compatible(*pair))):
                    break
                token = shorter[token]
            if token is None:  # nothing fits here: give up this position and shorten the token before it
                dead.add(at)
                token = ids.pop()
                at -= length[token]
                token = shorter[token]
                continue
            ids.append(token)
            if end == size:
                return ids
            at = end
            _, token = next(longest_matches(text[at : at + reach]))

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern in a text."""
        return (self.plain if max(text, default="") < FIRST_NEWER else self.dated).findall(text)

    def _packed(self, piece: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.encode_piece(piece.encode("utf-8"))))

    def _piece(self, piece: str) -> bytes:
        """Packed ids of one match of the pattern, remembered."""
        out = self.remembered_pieces.get(piece)
        if out is None:
            out = self._packed(piece)
            if len(piece) <= 64:
                self.remembered_pieces[piece] = out
        return out

    def _word(self, word: str) -> bytes:
        """Packed ids of letters after a space, remembered as the part that they are alone."""
        out = self.remembered.get(word)
        if out is None:
            out = self.older.get(word)
            if out is None:
                out = self._packed(" " + word)
            if len(word) <= 64:
                self.remembered[word] = out
        return out

    def _part(self, part: str) -> bytes:
        """Packed ids of a part of a text."""
        spaced = part[:1] == " "
        word = part[1:] if spaced else part
        if word.isalpha():
            return self._word(word) if spaced else self._piece(part)
        stem = word.rstrip(_MARKS)
        if stem.isalpha():  # letters and then marks: two matches
            cut = len(part) - len(word) + len(stem)
            return (self._word(stem) if spaced else self._piece(stem)) + self._piece(part[cut:])
        return b"".join(map(self._piece, self.pieces(part)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        Under SPACED_PATTERN a text is cut before every single space that stands between two characters that are no
        white space: a new piece always starts there, so the parts can be encoded, and remembered, apart.
        """
        if not text:
            return b""
        known, older, out = self.remembered, self.older, []
        if not self.spaced:
            out = list(map(self._piece, self.pieces(text)))
        for part in text.split(" ") if self.spaced else ():
            ids = known.get(part)
            if ids is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    out = [self._part(x if k == 0 else " " + x) for k, x in enumerate(_LONE_SPACE.split(text))]
                    break
                ids = older.get(part)
                if ids is None:
                    ids = self._part(" " + part)
                if len(part) <= 64:
                    known[part] = ids
            out.append(ids if out else self._part(part))
        if len(known) + len(self.remembered_pieces) > MAX_REMEMBERED // 2:
            self.older, self.remembered = known, {}  # what is still in use comes back from the older half
            self.remembered_pieces.clear()
        if len(self.fits) > MAX_REMEMBERED:
            self.fits.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


#: Marks that the pattern takes together when they end a part.
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
_LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
_MODELS: dict[tuple[str, str], ByteBPE] = {}


def _model(data: bytes, pattern: str) -> ByteBPE:
    """One model for each Python worker, kept from task to task."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = ByteBPE(parse_ranks(data), pattern)
    return _MODELS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text and decode it again.

    Returns doc_id, ids binary (little-endian unsigned 32-bit), decoded binary for each row.  A null text counts
    as empty and has no ids; empty tables give empty results; repeated rows are encoded each; other columns of
    docs are not read.  A very long text is handled in time and memory proportional to it.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoder(docs.sparkSession, ranks_path, pattern, False), "doc_id long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode_documents with digests in place of the ids and bytes: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(docs.sparkSession, ranks_path, pattern, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoder(spark: SparkSession, ranks_path: str, pattern: str, digests: bool):
    in_small_batches(spark)
    with open(ranks_path, "rb") as f:
        data = f.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{ranks_path} is larger than {MAX_RANKS_BYTES} bytes")
    shared = spark.sparkContext.broadcast(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value, pattern)
        for batch in text_slices(batches):
            ids = [model.encode(t) for t in texts_of(batch)]
            decoded = [model.decode(x) for x in ids]
            key = batch.column(0).cast(pa.int64())
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encode
