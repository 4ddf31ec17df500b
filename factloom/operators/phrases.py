"""Phrases with alternatives and bounded gaps, all looked for in one pass over the words of a text.

A phrase is written as words with blanks between: `a|b` is either word, `#` any number, and `_4` leaves room for up to
four words of any kind, as in `requires _6 level|quest`.  The words of all phrases make an index; a fold over
those words of a text that are in the index carries the place where each beginning of a phrase was last met.  The
last place is enough: it leaves the smallest gap to what follows.  The fold runs on Arrow batches in tasks: as nested
folds of columns it took most of the time of a record.  The same phrases as regular expressions serve SQL.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words of any script.
BETWEEN = r"[^\p{L}\p{M}\p{N}_]+"
_FAR = -(1 << 20)


def words(text: Column) -> Column:
    """The words of a text that is in lower case, in order."""
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def line_of_words(text: Column) -> Column:
    """The words of a text that is in lower case, with blanks between."""
    return F.regexp_replace(text, BETWEEN, " ")


def _parts(phrase: str) -> list[tuple[list[str], int]]:
    """The alternatives of each word and how many words may stand before it."""
    out, gap = [], 0
    for token in phrase.split():
        if re.fullmatch(r"_\d+", token):
            gap = int(token[1:])
        else:
            out.append((token.split("|"), gap))
            gap = 0
    if not out or gap:
        raise ValueError(f"a phrase begins and ends with words: {phrase!r}")
    return out


def _either(bits) -> int:
    return reduce(or_, bits, 0)


class Phrases:
    """Compiled phrases of named categories, 62 of these at most; `counted` are categories whose phrases are also told
    apart, so that a text's different ones can be counted (62 phrases in all at most)."""

    def __init__(self, categories: dict[str, list[str]], counted: list[str] | tuple[str, ...] = ()):
        self.names, self.own = list(categories), {c: 0 for c in counted}
        if len(self.names) > 62 or sum(len(categories[c]) for c in counted) > 62:
            raise ValueError("more than 62 categories, or counted phrases")
        index: dict[str, list[tuple[int, int, int, int, int, int]]] = {}
        # longer phrases, as bits, by the words that may be first, second and last in them
        self.places: tuple[dict[str, int], ...] = ({}, {}, {})
        states = told = self.n_long = self.roomy = 0  # roomy: those that leave room after their first word
        for k, (category, phrases) in enumerate(categories.items()):
            for phrase in phrases:
                parts, before, own = _parts(phrase), -1, 0
                if category in self.own:
                    own, told = 1 << told, told + 1
                    self.own[category] |= own
                if len(parts) > 1:
                    for side, (alternatives, _) in zip(self.places, (parts[0], parts[1], parts[-1]), strict=True):
                        side |= {word: side.get(word, 0) | 1 << self.n_long for word in alternatives}
                    self.roomy |= (parts[1][1] > 0) << self.n_long
                    self.n_long += 1
                for at, (alternatives, gap) in enumerate(parts):
                    last = at == len(parts) - 1
                    state = -1 if last else states
                    for word in dict.fromkeys(alternatives):
                        index.setdefault(word, []).append((at, state, before, gap, 1 << k if last else 0, own if last else 0))
                    before, states = state, states + (not last)
        # later words of a phrase first, so that no word is two of them
        self.index = {w: sorted(steps, key=lambda s: -s[0]) for w, steps in index.items()}
        # what a word tells by itself is put together, the steps of longer phrases follow in order
        self.steps = {w: (_either(s[4] for s in steps if s[1] < 0 > s[2]), _either(s[5] for s in steps if s[1] < 0 > s[2]), [s for s in steps if s[1] >= 0 or s[2] >= 0]) for w, steps in self.index.items()}
        self.categories = categories

    def fold(self, of: list[str]) -> tuple[int, int]:
        """The categories that the words in order meet, and the counted phrases, as bits."""
        bits = own = 0
        last: dict[int, int] = {}
        steps, number = self.steps, self.steps.get("#")
        for at, w in [(i, w) for i, w in enumerate(of) if w in steps or w[0] <= "9"]:
            step = number if number and w[0] <= "9" and w.isascii() and w.isdigit() else steps.get(w)
            if step is None:
                continue
            bits, own = self.step(step[2], at, last, bits | step[0], own | step[1])
        return bits, own

    @staticmethod
    def step(longer: list[tuple], at: int, last: dict[int, int], bits: int, own: int) -> tuple[int, int]:
        """What longer phrases add that have the word at this place; last: where each beginning was last met."""
        for _, state, before, gap, met, told in longer:
            if before < 0 or 1 <= at - last.get(before, _FAR) <= gap + 1:
                bits, own = bits | met, own | told
                if state >= 0:
                    last[state] = at
        return bits, own

    def found(self, of: Column) -> Column:
        """struct<bits, own> over an array of words: the categories met, and the counted phrases."""
        fold = self.fold

        def phrases(lines: pa.Array) -> pa.Array:
            got = [None if line is None else fold(line.split()) for line in lines.to_pylist()]
            return pa.array([None if g is None else dict(zip(("bits", "own"), g, strict=True)) for g in got], pa.struct([("bits", pa.int64()), ("own", pa.int64())]))

        return F.arrow_udf(phrases, "bits bigint, own bigint")(F.array_join(of, " "))

    def has(self, bits: Column, category: str) -> Column:
        return bits.bitwiseAND(F.lit(1 << self.names.index(category))) != 0

    def count(self, own: Column, category: str) -> Column:
        """How many different phrases of a counted category were met."""
        return F.bit_count(own.bitwiseAND(F.lit(self.own[category]))).cast("bigint")

    # The same for SQL, over the words joined by blanks with one before and one after.

    @staticmethod
    def pattern(phrase: str) -> str:
        out = ""
        for alternatives, gap in _parts(phrase):
            out += (f"(?: [^ ]+){{0,{gap}}}" if gap else "") + " (?:" + "|".join("[0-9]+" if w == "#" else w for w in alternatives) + ")"
        return out + " "

    def sql_has(self, line: str, category: str) -> str:
        phrases = self.categories[category]
        return f"regexp_matches({line}, '{'|'.join(map(self.pattern, phrases))}')" if phrases else "false"

    def sql_count(self, line: str, category: str) -> str:
        return " + ".join(f"CAST(regexp_matches({line}, '{self.pattern(p)}') AS INT)" for p in self.categories[category]) or "0"


def once(column: Column) -> Column:
    """The column behind a barrier: what is computed for it is not copied into every expression that uses it, as
    expressions over the partition's number are never merged with those above them."""
    return F.when(F.spark_partition_id() >= 0, column)
