"""Sections and chunks of texts, as arrays within each row: nothing is shuffled, a text is one row from end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X

# Below which number of tokens a section is tiny, and how large chunks may be and should be at least.
TINY, LEAST_CHUNK, MOST_CHUNK = 120, 500, 1500
_SECTION = "array<struct<heading: string, text: string, tokens: bigint, path: string, parent: string, depth: int>>"


def _blank(lines: Column, i: Column, n: Column) -> Column:
    """Whether the line at i is blank or beyond the text."""
    return (i < 0) | (i >= n) | (F.trim(F.coalesce(F.get(lines, i), F.lit(""))) == "")


def is_strong_heading(line: Column) -> Column:
    return F.trim(line).rlike("^(#{1,6}\\s+\\S|\\d+(?:\\.\\d+)*[.)]?\\s+\\S)")


def heading_level(line: Column) -> Column:
    """Hashes by their number, numbered headings 2, others 1."""
    hashes = F.length(F.regexp_extract(F.trim(line), "^(#{1,6})\\s", 1))
    return F.when(hashes > 0, hashes).when(F.trim(line).rlike("^\\d+(?:\\.\\d+)*[.)]?\\s"), 2).otherwise(1)


def heading_title(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(line), "^(#{1,6}|\\d+(?:\\.\\d+)*[.)]?)\\s+", ""))


def _section(heading: Column, body: Column) -> Column:
    text = F.concat_ws("\n", F.nullif(heading, F.lit("")), F.nullif(body, F.lit("")))
    return F.struct(heading.alias("heading"), text.alias("text"), X.estimate_tokens(text).alias("tokens"))


def with_sections(df: DataFrame, text: str, name: str = "sections") -> DataFrame:
    """df with an array of (heading, text, tokens): a new section at each strong heading and at each line that is one
    by its signs (0.55 or more) beside a blank line; without any, paragraphs.  Null and empty texts have none.

    Lines and places of headings are columns of their own for the time, so that they are made once for each text.
    """
    df = df.withColumn("_lines", F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n"))
    df = df.withColumn("_signs", F.transform("_lines", lambda x: F.when(F.trim(x) == "", 0).when(is_strong_heading(x), 2).when(X.heading_confidence(x) >= 0.55, 1).otherwise(0)))
    lines, signs, n = F.col("_lines"), F.col("_signs"), F.size("_lines")
    df = df.withColumn("_heads", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(signs, i) == 2) | ((F.get(signs, i) == 1) & (_blank(lines, i - 1, n) | _blank(lines, i + 1, n)))))
    heads = F.col("_heads")
    until = lambda k: F.coalesce(F.get(heads, k), n)
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, "^\\s+", ""), "\\s+$", "")
    first = F.array(_section(F.lit(""), clean(F.array_join(F.slice(lines, F.lit(1), until(F.lit(0))), "\n"))))
    rest = F.transform(heads, lambda at, k: _section(F.trim(F.get(lines, at)), clean(F.array_join(F.slice(lines, at + 2, until(k + 1) - at - 1), "\n"))))
    paragraphs = F.transform(F.split(F.array_join(lines, "\n"), "\n[ \t]*(?:\n[ \t]*)+"), lambda p: _section(F.lit(""), clean(p)))
    out = F.when(F.size(heads) > 0, F.concat(first, rest)).otherwise(paragraphs)
    return df.withColumn(name, F.filter(out, lambda s: s["text"] != "")).drop("_lines", "_signs", "_heads")


def merge_tiny_sections(sections: Column) -> Column:
    """A tiny section without a heading goes to the one before, if that has none either."""
    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        whole = F.concat(last["text"], F.lit("\n\n"), s["text"])
        joined = F.struct(last["heading"].alias("heading"), whole.alias("text"), X.estimate_tokens(whole).alias("tokens"))
        fold = (F.size(done) > 0) & (s["tokens"] < TINY) & (last["heading"] == "") & (s["heading"] == "")
        return F.when(fold, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(sections, F.array().cast("array<struct<heading: string, text: string, tokens: bigint>>"), step)


def with_paths(sections: Column) -> Column:
    """Sections with the titles above and of them as path, the path above as parent, and how deep they lie.

    A heading ends all headings of its level and deeper; what stands before the first has an empty path.
    """
    start = F.struct(F.array().cast(_SECTION).alias("out"), F.array().cast("array<struct<level: int, title: string>>").alias("stack"))

    def step(a: Column, s: Column) -> Column:
        level = heading_level(s["heading"])
        above = F.filter(a["stack"], lambda x: x["level"] < level)
        stack = F.when(s["heading"] == "", a["stack"]).otherwise(F.concat(above, F.array(F.struct(level.alias("level"), heading_title(s["heading"]).alias("title")))))
        titles = F.transform(stack, lambda x: x["title"])
        placed = F.struct(s["heading"], s["text"], s["tokens"], F.array_join(titles, " > ").alias("path"), F.array_join(F.slice(titles, F.lit(1), F.greatest(F.size(titles) - 1, F.lit(0))), " > ").alias("parent"), F.size(stack).alias("depth"))
        return F.struct(F.concat(a["out"], F.array(placed)).alias("out"), stack.alias("stack"))

    return F.aggregate(sections, start, step, lambda a: a["out"])


def _joined(a: Column, b: Column) -> Column:
    whole = F.concat(a["text"], F.lit("\n\n"), b["text"])
    return F.struct(a["heading"], whole.alias("text"), X.estimate_tokens(whole).alias("tokens"), a["path"], a["parent"], a["depth"])


def merge_same_path(sections: Column) -> Column:
    """A tiny section goes to the one before, if that has the same path."""
    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        fold = (F.size(done) > 0) & (s["tokens"] < TINY) & (last["path"] == s["path"])
        return F.when(fold, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(_joined(last, s)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(sections, F.array().cast(_SECTION), step)


def merge_to_budget(sections: Column, most: int) -> Column:
    """While there are more sections than most, the neighbours of the smallest sum become one: those of one parent
    first, where there are any, and the first on equal sums."""
    def step(a: Column, _: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(a) - 2)
        cost = F.transform(at, lambda i: F.struct(((F.get(a, i)["parent"] != F.get(a, i + 1)["parent"]) | (F.get(a, i)["parent"] == "")).alias("apart"), (F.get(a, i)["tokens"] + F.get(a, i + 1)["tokens"]).alias("n"), i.alias("i")))
        best = F.array_min(cost)["i"]
        return F.concat(F.slice(a, F.lit(1), best), F.array(_joined(F.get(a, best), F.get(a, best + 1))), F.slice(a, best + 3, F.size(a)))

    rounds = F.when(F.size(sections) > most, F.sequence(F.lit(1), F.size(sections) - most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, sections, step)


def pack(parts: Column, most: int | Column = MOST_CHUNK, between: str = " ") -> Column:
    """Texts packed in order into chunks of at most so many tokens; one that is larger stands by itself."""
    most = F.lit(most) if isinstance(most, int) else most

    def step(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        whole = F.concat(last, F.lit(between), p)
        fits = (F.size(done) > 0) & (X.estimate_tokens(whole) <= most)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(whole))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def split_large(text: Column, most: int = MOST_CHUNK) -> Column:
    """A text in chunks of at most so many tokens: whole sentences, or words where a sentence is larger than that."""
    sentences = F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda s: s != "")
    small = F.flatten(F.transform(sentences, lambda s: F.when(X.estimate_tokens(s) > most, pack(F.filter(F.split(s, "\\s+"), lambda w: w != ""), most)).otherwise(F.array(s))))
    return pack(small, most)


def chunk_texts(text: Column, sections: Column, chunks: int | None = None, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> Column:
    """Chunks of a text and its sections (with_sections), in order: sections packed until a chunk has its target of tokens, larger ones split.

    The target is between least and most; with a wished number of chunks it is the text's share of that.  Null and
    empty texts have no chunk; every chunk but an unsplittable word has at most `most` tokens.
    """
    sections = F.transform(merge_tiny_sections(sections), lambda s: s["text"])
    target = F.lit(most) if chunks is None else F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(X.estimate_tokens(text) / chunks)))
    small = F.flatten(F.transform(sections, lambda s: F.when(X.estimate_tokens(s) > most, split_large(s, most)).otherwise(F.array(s))))
    return pack(small, target, "\n\n")
