"""What the words of many facts tell, a batch at once.

The words of a batch become numbers, so that what a word tells is worked out once for each different word and put
together for each fact with Arrow and numpy.  Only facts that hold the first, second and last word of a longer phrase
are folded, over the words of such phrases (see `phrases`).  Nothing is kept from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.operators.phrases import Phrases

#: ASCII characters that stand between words as blanks; all other bytes as they are.
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
#: Bytes of text that are worked on at once (one row at least).
MOST_BYTES = 8 << 20


def split_words(piece: str) -> list[str]:
    """The words of a piece of text without ASCII separators: letters, marks, numbers and _ of any script."""
    return "".join(c if c == "_" or category(c)[0] in "LMN" else " " for c in piece).split()


def _either(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """All values of each row as one, bit by bit; row ascends."""
    out = np.zeros(n, values.dtype)
    if len(row):
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[at]] = np.bitwise_or.reduceat(values, at)
    return out


def _distinct(ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many different ids each row has."""
    if not len(ids):
        return np.zeros(n, np.int64)
    width = int(ids.max()) + 1
    keys = np.sort(row * width + ids)
    return np.bincount(keys[np.r_[True, keys[1:] != keys[:-1]]] // width, minlength=n)


def _spread(counts: np.ndarray, of: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The lists numbered by `of`, one after the other; they stand in flat, so many entries each."""
    each = counts[of]
    starts = (np.cumsum(counts) - counts)[of] - (np.cumsum(each) - each)
    return flat[np.arange(int(each.sum())) + np.repeat(starts, each)]


def _bools(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def _list_array(ids: np.ndarray, most: int, names: pa.Array) -> pa.Array:
    """The names of each line of ids that are not -1, the first of equal ones, no more than so many."""
    on = ids >= 0
    for k in range(1, ids.shape[1]):
        on[:, k] &= ~(ids[:, :k] == ids[:, k : k + 1]).any(axis=1)
    on &= np.cumsum(on, axis=1) <= most
    ends = np.append(0, np.cumsum(on.sum(axis=1)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(ids[on])))


def _first(row: np.ndarray, ids: np.ndarray, most: int, n: int) -> np.ndarray:
    """The first different ids of each row, in a line of so many, else -1; row ascends."""
    out = np.full((n, most), -1, np.int64)
    if len(ids):
        first = np.sort(np.unique(row * (int(ids.max()) + 1) + ids, return_index=True)[1])
        row, ids = row[first], ids[first]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        on = place < most
        out[row[on], place[on]] = ids[on]
    return out


def in_parts(docs: pa.RecordBatch, texts: str) -> Iterator[pa.RecordBatch]:
    """Rows with a list of texts each, part by part of MOST_BYTES (one row at least)."""
    ends = docs[texts].offsets.to_numpy()
    size = np.append(0, np.cumsum(pc.binary_length(docs[texts].values).fill_null(0).to_numpy()))[ends]
    at = 0
    while at < len(docs):
        to = max(at + 1, int(np.searchsorted(size, size[at] + MOST_BYTES, side="right")) - 1)
        yield docs[at:to]
        at = to


def collapsed(texts: pa.Array) -> pa.Array:
    """White space runs to one blank, ends trimmed, as `functions.text.collapse` does."""
    odd = pc.match_substring_regex(texts, "[\\t-\\r]|  |^ | $").fill_null(False)
    return pc.replace_with_mask(texts, odd, pc.utf8_trim(pc.replace_substring_regex(texts.filter(odd), "[\\t-\\r ]+", " "), " "))


def with_edges(pieces: pa.Array, doc: np.ndarray, most: int) -> pa.Array:
    """Each piece (null: empty) with so many characters of the one before and of the one after it in its document, blanks
    between."""
    at, joined = np.arange(len(doc)), np.append(doc[1:] == doc[:-1], False)
    side = lambda step, on, cut: cut.take(pa.array(at + step, mask=~on))
    before = side(-1, np.append(False, joined[:-1]), pc.utf8_slice_codeunits(pieces, -most))
    after = side(1, joined, pc.utf8_slice_codeunits(pieces, 0, most))
    return pc.binary_join_element_wise(before, pieces.fill_null(""), after, " ", null_handling="skip")


class _Side:
    """A set of phrases by the words that they hold: a line for each with the categories and counted phrases that it
    meets alone, and the longer phrases that it is the first, second and last word of, 64 of these a column; line 0 is that
    of other words.  Phrases whose second word follows the first at once are told from those with room between."""

    def __init__(self, phrases: Phrases):
        keys, self.columns = list(phrases.steps), -(-phrases.n_long // 64)
        cut = lambda bits: [bits >> 64 * k & (1 << 64) - 1 for k in range(self.columns)]
        lines = [[*phrases.steps[w][:2], *(bits for of in phrases.places for bits in cut(of.get(w, 0)))] for w in keys]
        self.keys = pa.array(keys, pa.large_string())
        self.lines = np.array([[0] * (2 + 3 * self.columns), *lines], np.uint64)
        self.roomy = np.array(cut(phrases.roomy), np.uint64)
        self.longer = [[], *(phrases.steps[w][2] for w in keys)]
        self.far = np.array([bool(steps) for steps in self.longer])
        self.number = keys.index("#") + 1 if "#" in phrases.steps else 0
        self.step = phrases.step

    def of(self, words: pa.Array, numbers: np.ndarray) -> np.ndarray:
        """The line of each word."""
        out = pc.index_in(words, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64) + 1
        if self.number:
            out[numbers] = self.number
        return out

    def fold(self, line: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The categories and the counted phrases that each row meets; line and row of every word in order."""
        at = np.flatnonzero(line)
        line, row = line[at], row[at]
        bits, own = (_either(self.lines[line, k], row, n) for k in (0, 1))
        far = self.far[line]
        at, line, row = at[far], line[far], row[far]
        may = np.zeros(n, bool)
        pair = np.flatnonzero((at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]))
        for k in range(self.columns):
            of = lambda place: self.lines[:, 2 + place * self.columns + k]  # noqa: B023, E731
            both = _either(of(0)[line[pair]] & of(1)[line[pair + 1]], row[pair], n)
            if self.roomy[k]:
                both |= _either(of(0)[line], row, n) & _either(of(1)[line], row, n) & self.roomy[k]
            may |= (both & _either(of(2)[line], row, n)) != 0
        some = np.flatnonzero(may)
        begins, ends = np.searchsorted(row, some).tolist(), np.searchsorted(row, some + 1).tolist()
        at, line = at.tolist(), line.tolist()
        for r, b, e in zip(some.tolist(), begins, ends, strict=True):
            met = told = 0
            last: dict[int, int] = {}
            for i in range(b, e):
                met, told = self.step(self.longer[line[i]], at[i], last, met, told)
            bits[r] |= np.uint64(met)
            own[r] |= np.uint64(told)
        return bits, own


class Told:
    """Function of facts and what stands around them, both in lower case, to arrays of their counts and lists."""

    def __init__(self, found: Phrases, around: Phrases, systems: dict[str, str], families: dict[str, str], family_of: dict[str, str], synonyms: dict[str, str], generic: list[str]):
        self.found, self.around = _Side(found), _Side(around)
        self.systems, self.families, self.family_of, self.synonyms = systems, families, family_of, synonyms
        self.generic = pa.array(sorted(set(generic)), pa.large_string())
        entries = {*systems, *families}
        self.whole = pa.array(sorted(e for e in entries if e[:1] != "-"), pa.large_string())
        self.names = sorted({*systems.values(), *families.values(), *family_of.values(), "other"})
        self.ends = sorted(e[1:] for e in entries if e[:1] == "-")

    def __call__(self, low: pa.Array, around: pa.Array) -> list[tuple[list[np.ndarray], list[pa.Array]]]:
        """Counts and lists, part by part of MOST_BYTES."""
        low, around = (x.cast(pa.large_string()).fill_null("") for x in (low, around))
        size = np.cumsum(pc.binary_length(low).to_numpy() + pc.binary_length(around).to_numpy())
        out, at = [], 0
        while at < len(low) or not out:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + MOST_BYTES, side="right")))
            out.append(self._part(low[at:to], around[at:to]))
            at = to
        return out

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different words of texts; the number and the row of every word in order."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        text = np.frombuffer((held.to_pybytes() if held else b"")[offsets[0] : offsets[-1]].translate(_BLANKED), np.uint8)
        offsets = offsets - offsets[0]
        inside = text != 32
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(text)]
        begins[at] = inside[at]
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(inside & np.append(begins[1:] | ~inside[1:], True)) + 1
        row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
        places = np.append(0, np.cumsum(ends - starts))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(text[inside])).dictionary_encode()
        index, pieces = pieces.indices.to_numpy().astype(np.int64), pieces.dictionary
        whole = _bools(pc.or_(pc.string_is_ascii(pieces), pc.utf8_is_alnum(pieces)))
        if whole.all():
            return pieces, index, row
        parts = [split_words(p) for p in pieces.filter(pa.array(~whole)).to_pylist()]
        counts = np.ones(len(pieces), np.int64)
        counts[~whole] = [len(p) for p in parts]
        owner = np.repeat(np.arange(len(pieces)), counts)
        words = pa.concat_arrays([pieces.filter(pa.array(whole)), pa.array([w for p in parts for w in p], pa.large_string())]).dictionary_encode()
        flat = np.empty(len(owner), np.int64)
        ids = words.indices.to_numpy()
        flat[whole[owner]], flat[~whole[owner]] = ids[: int(whole.sum())], ids[int(whole.sum()) :]
        return words.dictionary, _spread(counts, index, flat), np.repeat(row, counts[index])

    def _tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each word has, and their numbers, word by word: that of the word that is the same, or a new one."""
        plain = _bools(pc.match_substring_regex(words, "^[a-z0-9]*$"))
        counts = (plain & (pc.utf8_length(words).to_numpy() >= 3)).astype(np.int64)
        parts = pc.split_pattern(pc.replace_substring_regex(words.filter(pa.array(~plain)), "[^a-z0-9]+", " "), " ")
        more, of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
        on = pc.binary_length(more).to_numpy() >= 3
        more = more.filter(pa.array(on))
        counts[~plain] = np.bincount(of[on], minlength=len(parts))
        owner = np.repeat(np.arange(len(words)), counts)
        same = pc.index_in(more, value_set=words).fill_null(-1).to_numpy()
        new = more.dictionary_encode().indices.to_numpy()
        flat = owner.copy()
        flat[~plain[owner]] = np.where(same >= 0, same, len(words) + new)
        return counts, flat

    def _part(self, low: pa.Array, around: pa.Array) -> tuple[list[np.ndarray], list[pa.Array]]:
        n = len(low)
        words, wid, row = self._words(pa.concat_arrays([low, around]))
        cut = int(np.searchsorted(row, n))
        return self._tell(words, wid[:cut], row[:cut], wid[cut:], row[cut:] - n, n)

    def pieces(self, low: pa.Array, tail: pa.Array, head: pa.Array, doc: np.ndarray) -> tuple[list[np.ndarray], list[pa.Array]]:
        """The same for the pieces of documents in lower case and in order, each with the piece before and after it
        around: of a long one its tail and head, which are null for others.  The words of a piece are read once."""
        n = len(low)
        low, tail, head = (x.cast(pa.large_string()) for x in (low.fill_null(""), tail, head))
        cut = [_bools(pc.is_valid(x)) for x in (tail, head)]
        words, wid, row = self._words(pa.concat_arrays([low, tail.drop_null(), head.drop_null()]))
        units = n + sum(int(x.sum()) for x in cut)
        counts = np.append(np.bincount(row, minlength=units), 0)  # the last is nothing
        sides = np.tile(np.arange(n), (2, 1))
        sides[0, cut[0]], sides[1, cut[1]] = np.split(np.arange(n, units), [int(cut[0].sum())])
        joined = doc[1:] == doc[:-1]
        around = np.full((n, 3), units)
        around[:, 1] = np.arange(n)
        around[1:, 0], around[:-1, 2] = np.where(joined, sides[0, :-1], units), np.where(joined, sides[1, 1:], units)
        wid_around, row_around = _spread(counts, around.ravel(), wid), np.repeat(np.arange(n), counts[around].sum(axis=1))
        own = int(np.searchsorted(row, n))
        return self._tell(words, wid[:own], row[:own], wid_around, row_around, n)

    def _tell(self, words: pa.Array, wid: np.ndarray, row: np.ndarray, wid_around: np.ndarray, row_around: np.ndarray, n: int) -> tuple[list[np.ndarray], list[pa.Array]]:
        numbers = _bools(pc.match_substring_regex(words, "^[0-9]+$"))
        bits, own = self.found.fold(self.found.of(words, numbers)[wid], row, n)
        near, _ = self.around.fold(self.around.of(words, numbers)[wid_around], row_around, n)
        chars = pc.utf8_length(words).to_numpy()
        telling = (chars >= 4) & ~_bools(pc.is_in(words, value_set=self.generic))
        has, has_around = telling[wid], telling[wid_around]
        counts, tokens = self._tokens(words)
        token, token_row = _spread(counts, wid, tokens), np.repeat(row, counts[wid])
        out = [bits, own, near, _distinct(wid[has], row[has], n), _distinct(wid_around[has_around], row_around[has_around], n), np.bincount(token_row, minlength=n), _distinct(token, token_row, n)]
        return [x.astype(np.int64) for x in out], self._lists(words, chars >= 6, wid, row, n)

    def _entries(self, word: str, by: dict[str, str]) -> list[str]:
        return [by[e] for e in (word, "-" + word[-4:], "-" + word[-2:]) if e in by]

    def _lists(self, words: pa.Array, long: np.ndarray, wid: np.ndarray, row: np.ndarray, n: int) -> list[pa.Array]:
        """Systems, families, keywords and entities of each row, by its words in the order in which they are first met."""
        entry = pc.is_in(words, value_set=self.whole)
        for end in self.ends:
            entry = pc.or_(entry, pc.ends_with(words, end))
        entry = _bools(entry)
        number = {name: k for k, name in enumerate(self.names)}
        told = [[[number[x] for x in self._entries(w, by)] for by in (self.systems, self.families)] for w in words.filter(pa.array(entry)).to_pylist()]
        place = np.cumsum(entry) - 1
        at = np.flatnonzero(entry[wid])
        of, at = place[wid[at]], row[at]

        def met(k: int) -> tuple[np.ndarray, np.ndarray]:
            counts = np.array([len(t[k]) for t in told], np.int64)
            return np.repeat(at, counts[of]), _spread(counts, of, np.array([x for t in told for x in t[k]], np.int64))

        own = _first(*met(0), 4, n)
        held = np.nonzero(own >= 0)
        family = np.array([number[self.family_of.get(name, "other")] for name in self.names], np.int64)
        (rows, ids), more = met(1), family[own[held]]
        rows, ids = np.append(rows, held[0]), np.append(ids, more)
        order = np.argsort(rows, kind="stable")  # the families of systems after those of words
        classes = _first(rows[order], ids[order], 4, n)
        is_long = long[wid]
        keywords = _first(row[is_long], wid[is_long], 3, n)
        used, back = np.unique(keywords[keywords >= 0], return_inverse=True)
        keys = [self.synonyms.get(w, w) for w in words.take(pa.array(used)).to_pylist()]
        names = pa.array([*self.names, *keys], pa.string()).dictionary_encode()
        keywords[keywords >= 0] = names.indices.to_numpy()[len(self.names) :][back]
        return [_list_array(x, most, names.dictionary) for x, most in ((own, 4), (classes, 4), (keywords, 3), (np.hstack([own, classes, keywords]), 6))]
