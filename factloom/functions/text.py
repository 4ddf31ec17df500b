"""Text expressions: keys, tokens, identifiers, scores.  All are columns; none needs Python on the executors."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STR = Column | str


def _c(x: STR) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize(x: STR) -> Column:
    """Line and paragraph separators become line ends; zero-width, direction and control characters go."""
    return F.regexp_replace(F.regexp_replace(_c(x), "[\u0085  ]", "\n"), "[​-‏‪-‮⁠﻿\\x00-\\x08\\x0b-\\x1f]", "")


def collapse(x: STR) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(x), "\\s+", " "))


def text_key(x: STR) -> Column:
    return F.lower(collapse(x))


def slug(x: STR, default: str | None = None) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return s if default is None else F.when(s == "", default).otherwise(s)


def word_key(x: STR) -> Column:
    """Lower-case ASCII letters and digits with single spaces: the key under which pages merge."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " "))


def tokens(x: STR, least: int = 3) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " ")), " "), lambda t: F.length(t) >= least)


def token_set(x: STR, least: int = 3) -> Column:
    return F.array_distinct(tokens(x, least))


def code_units(x: STR) -> Column:
    """Length in UTF-16 code units: a character beyond the first plane counts two."""
    return F.shiftright(F.octet_length(F.encode(_c(x), "UTF-16BE")), 1)


def estimate_tokens(x: STR) -> Column:
    """A fourth of the UTF-16 code units, rounded up; 0 for an empty or null text."""
    return F.ceil(F.coalesce(code_units(x), F.lit(0)) / 4).cast("bigint")


def djb2(x: STR) -> Column:
    """32-bit multiplicative hash of the UTF-16 code units, as hex: a character beyond the first plane is two."""
    step = lambda a, unit: F.pmod(a * 33 + unit, F.lit(4294967296))

    def add(a: Column, c: Column) -> Column:
        point = F.ascii(c).cast("bigint")
        high, low = F.lit(55296) + F.shiftright(point - 65536, 10), F.lit(56320) + (point - 65536).bitwiseAND(F.lit(1023))
        return F.when(point > 65535, step(step(a, high), low)).otherwise(step(a, point))

    return F.lower(F.hex(F.aggregate(F.filter(F.split(_c(x), ""), lambda c: c != ""), F.lit(5381).cast("bigint"), add)))


def sha1_id(x: STR, length: int = 12) -> Column:
    return F.substring(F.sha1(_c(x).cast("binary")), 1, length)


def decode_entities(x: STR) -> Column:
    """Six entities in a fixed order; &amp; comes second, so doubly encoded ones are decoded twice."""
    out = _c(x)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def clamp(x: STR) -> Column:
    """0 to 1; what is no finite number becomes null."""
    c = _c(x).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def bucketize(x: STR, bins: int = 5) -> Column:
    c = clamp(x)
    out = F.when(c.isNull(), "unknown")
    for k in range(1, bins):
        out = out.when(c < k / bins, f"{(k - 1) / bins:.1f}-{k / bins:.1f}")
    return out.otherwise(f"{(bins - 1) / bins:.1f}-1.0")


def normalize_priority(x: STR, low: int = 1, high: int = 3, default: int = 2) -> Column:
    """P1 is the highest priority and the largest number."""
    s = F.upper(F.trim(_c(x).cast("string")))
    n = s.try_cast("double")
    return F.when(s == "P1", high).when(s == "P2", high - 1).when(s == "P3", low).when(n.isNull(), default).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), F.round(n).cast("int"))))


def list_normalize(x: STR, longest: int = 24, most: int = 8) -> Column:
    """Trimmed, cut, case-folded first-wins distinct entries, at most so many."""
    clean = F.filter(F.transform(_c(x), lambda v: F.substring(collapse(v), 1, longest)), lambda v: v != "")
    return F.slice(F.aggregate(clean, F.array().cast("array<string>"), lambda a, v: F.when(F.exists(a, lambda w: F.lower(w) == F.lower(v)), a).otherwise(F.concat(a, F.array(v)))), 1, most)


def first_of_each(x: STR) -> Column:
    """Trimmed entries that are not empty, of those alike but for case the first, in their order.

    Entries are sorted by key and place and compared with their neighbours, so a long list costs no pairs of entries; a
    null list gives null, null entries go.
    """
    trimmed = F.transform(_c(x), lambda v, i: F.struct(F.lower(F.regexp_replace(v, "^\\s+|\\s+$", "")).alias("key"), i.alias("at"), F.regexp_replace(v, "^\\s+|\\s+$", "").alias("entry")))
    ordered = F.array_sort(F.filter(trimmed, lambda s: s["key"] != ""))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda s: s["key"]))
    new = F.zip_with(ordered, before, lambda s, k: F.when(s["key"].isNotNull() & ~s["key"].eqNullSafe(k), F.struct(s["at"].alias("at"), s["entry"].alias("entry"))))
    return F.transform(F.array_sort(F.array_compact(new)), lambda s: s["entry"])


#: Lengths of aliases and keywords, how many of each are kept, and words that are no keywords.
ALIAS_LENGTHS, KEYWORD_LENGTHS, MAX_ALIASES, MAX_KEYWORDS = (2, 64), (4, 32), 8, 12
COMMON_TERMS = (
    "game games gaming player players play playing build guide tips patch update meta ranked match matches online offline singleplayer multiplayer co-op coop pvp pve story mode modes level levels "
    "quest quests mission missions item items loot gear weapon weapons skill skills talent talents perk perks class classes boss bosses"
).split()


def pruned(x: STR, lengths: tuple[int, int], most: int, stop: list[str] | None = None) -> Column:
    """The first `most` distinct entries (first_of_each) whose length in code units is within `lengths` and whose lower
    case is no stop term."""
    fits = lambda v: code_units(v).between(*lengths) & (~F.lower(v).isin(stop) if stop else F.lit(True))
    return F.slice(F.filter(first_of_each(x), fits), 1, most)


def rate(hits: Column, total: Column) -> Column:
    """(hits, total, rate): the rate in thousandths, halves up; 0 where there is nothing to count."""
    share = F.when(total > 0, F.floor((hits * 2000 + total) / (total * 2)) / 1000).otherwise(F.lit(0.0))
    return F.struct(hits.alias("hits"), total.alias("total"), share.alias("rate"))


#: Endings of nouns and names by language; a parameter of without_ending.
ENDINGS = {"en": ["s", "es", "ed", "ing"], "de": ["n", "s", "e", "en", "er", "es", "em", "ern"], "fr": ["s", "x", "es", "aux"], "es": ["s", "es"]}


def without_ending(word: STR, lang: STR, endings: dict[str, list[str]] | None = None) -> Column:
    """The word without the longest ending of its language, of which at least two characters must stay; words of
    other languages, or of none, as they are.  A shorter ending is tried where too little stays without a longer one."""
    w, out = _c(word), _c(word)
    for code, ends in (ENDINGS if endings is None else endings).items():
        for e in sorted(ends, key=len):
            out = F.when((_c(lang) == code) & F.endswith(w, F.lit(e)) & (F.length(w) > len(e) + 1), F.substr(w, F.lit(1), F.length(w) - len(e))).otherwise(out)
    return out


def jaccard(a: STR, b: STR, both_empty: float = 1.0) -> Column:
    """Shared share of two sets; both_empty tells which of the two customary answers holds for empty ones."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def cosine(a: STR, b: STR) -> Column:
    """0 for unequal lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = _c(a), _c(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) != F.size(y)) | (norm == 0), F.lit(0.0)).otherwise(dot(x, y) / norm)


def words_pattern(words: list[str]) -> str:
    """One alternation for a whole lexicon category, with ASCII word ends on either side."""
    return "(?<![A-Za-z0-9_])(?:" + "|".join(words) + ")(?![A-Za-z0-9_])"


def ascii_bounds(pattern: str) -> str:
    """The pattern with \\b as a bound of ASCII words, whatever letters stand next to them."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def context_window(text: STR, fact: STR, around: int = 140, stop: list[str] | None = None) -> Column:
    """Text around the first token of the fact, of four letters or more and no stop word, that the text holds."""
    low = F.lower(_c(text))
    hits = F.filter(tokens(fact, 4), lambda t: F.contains(low, t) & ~t.isin(stop or ["that", "this", "with", "from", "when", "will", "your"]))
    at = F.instr(low, F.get(hits, F.lit(0)))
    start = F.greatest(F.lit(1), at - around)
    return F.when(F.size(hits) > 0, F.substring(_c(text), start, at - start + around))


# What speaks for a heading and what against it, in hundredths.
HEADING = {"hash": 60, "numbered": 35, "colon": 25, "title_case": 20, "capitals": 20, "two_words": -15, "short": -10, "slashes": -20, "marks": -15, "navigation": -25, "bullet": -20, "sentence_end": -20}
# Words of navigation.
NAVIGATION = ["home", "search", "navigation", "edit", "view", "history", "help", "portal", "category", "namespace", "page"]


def heading_signs(line: STR) -> dict[str, Column]:
    """What a line shows, by the names of HEADING."""
    s = F.trim(_c(line))
    words = F.filter(F.split(s, "\\s+"), lambda w: w != "")
    n, letters = F.size(words), F.regexp_count(s, F.lit("[A-Za-z]"))
    return {
        "hash": s.rlike("^#{1,6}\\s+\\S"), "numbered": s.rlike("^\\d+(?:\\.\\d+)*[.)]?\\s+\\S"), "colon": s.rlike(":$"), "title_case": (n > 0) & (n <= 10) & (F.size(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]+$"))) >= F.ceil(n * 0.6)),
        "capitals": (letters >= 6) & (F.regexp_count(s, F.lit("[A-Z]")) * 10 >= letters * 7), "two_words": n <= 2, "short": (n <= 4) & (F.length(s) <= 20), "slashes": F.regexp_count(s, F.lit("[|/\\\\]")) >= 2,
        "marks": F.regexp_count(s, F.lit("[:;.,\\-]")) >= 4, "navigation": s.rlike("(?i)" + words_pattern(NAVIGATION)), "bullet": s.rlike("^[-*\u2022]+\\s+"), "sentence_end": s.rlike("[.!?]$"),
    }


def heading_confidence(line: STR) -> Column:
    """Evidence that a line is a heading, from 0 to 1; 0 for an empty or null line."""
    total = sum((F.when(sign, HEADING[name]).otherwise(0) for name, sign in heading_signs(line).items()), F.lit(0))
    return F.when(F.coalesce(F.trim(_c(line)), F.lit("")) == "", 0.0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), total)) / 100)


# Letters with marks and what they are without; ligatures and other forms of compatibility.
PLAIN_LETTERS = {"ß": "ß", "æ": "æ", "ﬁ": "fi", "ﬂ": "fl", "①": "1", "²": "2", "³": "3", "½": "1\u20442", "…": "...", "™": "tm", "ª": "a", "º": "o"}


def fold_letters(x: STR) -> Column:
    """Lower case without marks on letters, and forms of compatibility as plain ones: NFKD without marks.

    There is no such expression built in, so distinct batches of texts pass through Arrow to the standard library.
    """

    @F.pandas_udf("string")
    def fold(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower(), na_action="ignore")

    return fold(_c(x))


def unicode_key(x: STR, join: str = " ") -> Column:
    """Folded letters and digits of any script, what stands between as `join`."""
    return F.trim(F.regexp_replace(fold_letters(x), "[^\\p{L}\\p{N}]+", join))


def search_key(x: STR) -> Column:
    """Folded text with single spaces, marks kept, as a search compares it."""
    return collapse(fold_letters(x))


def found_in(question: STR, answer: STR, needle: str) -> Column:
    """Whether a search finds an entry: its folded question and answer hold the folded needle; an empty one is found
    everywhere.  A null question or answer is empty."""
    key = " ".join("".join(c for c in unicodedata.normalize("NFKD", needle) if not unicodedata.combining(c)).lower().split())
    if not key:
        return F.lit(True)
    return F.contains(search_key(F.concat(F.coalesce(_c(question), F.lit("")), F.lit(" "), F.coalesce(_c(answer), F.lit("")))), F.lit(key))


def request_key(x: STR) -> Column:
    """Letters and digits of any script in lower case, words by single spaces; letters keep their marks."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^\\p{L}\\p{N}]+", " "))


def name_key(x: STR) -> Column:
    """Lower case with runs of white space, no-break spaces too, as one space."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[\\s\u00a0]+", " "))


def truncate(x: STR, most: int = 400) -> Column:
    """At most so many characters, and three dots where some are cut."""
    return F.when(F.length(_c(x)) > most, F.concat(F.substring(_c(x), 1, most), F.lit("..."))).otherwise(_c(x))


def path_key(x: STR) -> Column:
    """A path in lower case without backslashes at its end."""
    return F.regexp_replace(F.lower(_c(x)), "\\\\+$", "")


def percent(x: STR) -> Column:
    """A share as a percentage with one digit."""
    return F.when(_c(x).isNotNull(), F.concat(F.format_string("%.1f", _c(x) * 100), F.lit("%")))


def fact_id(given: STR, text: STR, source: STR, index: STR) -> Column:
    """The id that is given, else one made of text, source and index."""
    made = F.concat(F.lit("fact-"), djb2(F.concat_ws("::", F.coalesce(_c(text), F.lit("")), F.coalesce(_c(source), F.lit("")), _c(index).cast("string"))))
    return F.coalesce(F.nullif(F.trim(_c(given)), F.lit("")), made)


def around(text: STR, what: STR, most: int = 40) -> Column:
    """The text from `most` characters before the first place of what to as many after it; null where it has none."""
    at = F.instr(F.lower(_c(text)), F.lower(_c(what)))
    start = F.greatest(F.lit(1), at - most)
    return F.when(at > 0, F.substring(_c(text), start, at - start + F.length(_c(what)) + most))
