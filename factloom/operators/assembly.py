"""Chunk budgets, link scores and names: what stands between sections of a page and the facts shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text as X

# What a token of a link earns for each set of a page's signals that it is in, in hundredths, so that
# sums compare exactly.
SIGNALS = [("title", 30), ("heading", 25), ("subheading", 20), ("path", 15), ("lexicon", 12)]
LEAST_SCORE, FALLBACK_SCORE, FALLBACK_LINKS, MOST_LINKS = 12, 5, 3, 10


def merge_cheapest(sizes: Column, most: int = 10, cap: int = 1500) -> Column:
    """While there are more chunks than most, the adjacent pair of the smallest sum, the first on ties, becomes one.

    Stops where no pair fits the cap, so more chunks than most may stay.  Null stays null, empty stays empty.
    """
    def step(a: Column, _: Column) -> Column:
        n = F.size(a)
        sums = F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1), lambda x, y: x + y)
        best = F.array_min(sums)
        at = F.array_position(sums, best).cast("int")
        joined = F.concat(F.slice(a, F.lit(1), at - 1), F.array(best), F.slice(a, at + 2, n))
        return F.when(best <= cap, joined).otherwise(a)

    rounds = F.when(F.size(sizes) > most, F.sequence(F.lit(1), F.size(sizes) - most)).otherwise(F.array().cast("array<int>"))
    return F.when(sizes.isNotNull(), F.aggregate(rounds, sizes, step))


def merge_tiny(sizes: Column, least: int = 120) -> Column:
    """A chunk of fewer than `least` tokens goes to the one before, where that is as small.  Null stays null."""
    def step(a: Column, n: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(last + n))
        return F.when(F.size(a) == 0, F.array(n)).when((n < least) & (last < least), joined).otherwise(F.concat(a, F.array(n)))

    return F.when(sizes.isNotNull(), F.aggregate(sizes, F.array().cast("array<bigint>"), step))


def link_score(text: Column, url: Column, signals: dict[str, Column], density: Column | None = None) -> Column:
    """Hundredths, 100 at most: every token of text or address that is in a set counts for it, then long texts, texts
    of several tokens, and up to 20 for the density of the page's facts.  0 where there is no token."""
    own = X.tokens(text)
    t = F.array_distinct(F.concat(own, X.tokens(url)))
    points = sum((F.size(F.array_intersect(t, signals[name])) * w for name, w in SIGNALS), F.lit(0))
    points = points + F.when(F.length(text) >= 8, 5).otherwise(0) + F.when(F.size(own) >= 2, 5).otherwise(0)
    if density is not None:
        points = points + F.least(F.lit(20), F.floor(density * 100 / 80))
    return F.when(F.size(t) == 0, 0).otherwise(F.least(F.lit(100), points)).cast("bigint")


# Fixed value: what may be a name: words that begin with a capital letter, of three characters or more, and rows of them.
NAME = r"(?:^|[^\p{L}])(\p{Lu}[\p{L}\p{N}'-]{2,}(?:\s+\p{Lu}[\p{L}\p{N}'-]{2,})*)"


def names(text: str | Column) -> Column:
    """What may be names, in order, repeated ones too; of any script with capital letters."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(c, F.lit(NAME), F.lit(1))


def redact(text: Column, offenders: Column, mark: str = "[name]") -> Column:
    """Every whole name that is an offender becomes the mark, longer ones first; runs of blanks close up."""
    longest = F.array_sort(F.array_distinct(offenders), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    whole = lambda o: F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), o, F.lit("\\E(?![\\p{L}\\p{N}])"))
    out = F.aggregate(longest, text, lambda t, o: F.regexp_replace(t, whole(o), F.lit(mark.replace("$", ""))))
    return F.when(F.size(offenders) > 0, F.regexp_replace(out, " {2,}", " ")).otherwise(text)
