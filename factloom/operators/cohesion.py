"""How well the facts of a chunk hold together, which quoted names facts vouch for, and what a text asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many families and keywords of a chunk are its dominant ones.
TOP = {"families": 2, "keywords": 3}
#: Words that tell that a clause denies something, English and German; a parameter.
NEGATIONS = ["not", "no", "never", "without", "nicht", "kein", "keine", "nie", "ohne"]
#: Ends of a clause: punctuation, and words that turn to something else.
CLAUSE_ENDS = r"[.;!?,:]|\b(?:but|however|instead|aber|sondern|jedoch)\b"


def chunk_cohesion(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each chunk: its facts, distinct families, systems and keywords, dominant families and keywords, and
    the thousandths of its facts that have none of these.

    facts has the key and the arrays families, systems and keywords; a null or empty array has no entries, an entry
    counts once for a fact, rows with a null key belong to no chunk, repeated facts count each.  Dominant are the
    most frequent entries, then by name.  Entries are counted with partial sums and ranked by their counts; no list of a
    chunk's facts is made.
    """
    none = F.array().cast("array<string>")
    clean = {c: F.array_distinct(F.filter(F.coalesce(c, none), lambda x: x.isNotNull() & (x != ""))) for c in ("families", "systems", "keywords")}
    f = facts.where(F.col(key).isNotNull()).select(key, *[v.alias(c) for c, v in clean.items()])
    entries = lambda c: F.transform(c, lambda x: F.struct(F.lit(c).alias("kind"), x.alias("entry")))
    marked = F.concat(*map(entries, clean))
    counts = f.select(key, F.explode(marked).alias("m")).groupBy(key, "m").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy(key).agg(*[F.count_if(F.col("m.kind") == c).alias(f"n_{c}") for c in clean])
    # the limit on the rank is applied in every task before entries of a chunk are brought together
    ranked = counts.select(key, "m.kind", "m.entry", F.row_number().over(Window.partitionBy(key, "m.kind").orderBy(F.col("n").desc(), "m.entry")).alias("rank")).where(F.col("rank") <= max(TOP.values()))
    pairs = lambda c, k: F.array_sort(F.collect_list(F.when((F.col("kind") == c) & (F.col("rank") <= k), F.struct("rank", "entry"))))
    best = ranked.groupBy(key).agg(*[F.transform(pairs(c, k), lambda x: x["entry"]).alias(f"top_{c}") for c, k in TOP.items()]).join(spread, key)
    stray = ~F.arrays_overlap("families", "top_families") & ~F.arrays_overlap("keywords", "top_keywords")
    joined = f.join(best, key, "left").withColumns({c: F.coalesce(c, none) for c in ("top_families", "top_keywords")})
    whole = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(stray).alias("stray"), F.count_if(F.size("systems") > 1).alias("multi_system"),
        *[F.coalesce(F.any_value(f"n_{c}"), F.lit(0)).alias(f"n_{c}") for c in clean], *[F.any_value(f"top_{c}").alias(f"top_{c}") for c in TOP],
    )
    return whole.withColumn("drift", F.floor((F.col("stray") * 2000 + F.col("facts")) / (2 * F.col("facts"))).cast("bigint"))


def cohesion_summary(chunks: DataFrame) -> DataFrame:
    """One row over all rows of chunk_cohesion: how many, means by chunk, and the share of facts of several systems.
    Without chunks the means are 0."""
    n = F.count(F.lit(1))
    mean = lambda c: F.coalesce(F.round(F.sum(c) / n, 6), F.lit(0.0))
    return chunks.agg(
        n.alias("chunks"), mean("n_keywords").alias("mean_keywords"), mean("n_families").alias("mean_families"), mean("n_systems").alias("mean_systems"), mean("facts").alias("mean_facts"), mean("drift").alias("mean_drift"),
        F.coalesce(F.round(F.sum("multi_system") / F.nullif(F.sum("facts"), F.lit(0)), 6), F.lit(0.0)).alias("multi_system_share"),
    )


def quoted_names(text: Column, negations: list[str] | None = None) -> Column:
    """Names in double quotes, or in single quotes that do not stand within a word, of 2 to 60 characters, each with
    whether its clause denies it: an array of (name, denied); empty where the text is null.

    A clause ends at punctuation outside quotes and at words such as "but" (CLAUSE_ENDS); a word of negations
    anywhere before a name in its clause, outside quotes, denies it.  A mark pairs with the next one of its kind that is
    2 to 60 characters away, so what stands between two quoted single letters counts as a name too.
    """
    words = "|".join(NEGATIONS if negations is None else negations)
    quote = r"\"[^\"\r\n]{2,60}\"|(?<![\p{L}\p{N}])'[^'\r\n]{2,60}'(?![\p{L}\p{N}])"
    text = F.coalesce(text, F.lit(""))
    gaps, found = F.split(text, quote), F.regexp_extract_all(text, F.lit(quote), F.lit(0))
    marks = F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.lower(g))
    ends = F.transform(marks, lambda g: g.rlike(CLAUSE_ENDS))
    said = F.transform(marks, lambda g: F.element_at(F.split(g, CLAUSE_ENDS), -1).rlike(rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])"))
    # a name is denied by its own gap, or by an earlier one if no clause ended since
    step = lambda a, i: F.struct(
        (F.get(said, i) | (a["on"] & ~F.get(ends, i))).alias("on"),
        F.concat(a["out"], F.array(F.struct(F.trim(F.regexp_replace(F.get(found, i), r"^.|.$", "")).alias("name"), (F.get(said, i) | (a["on"] & ~F.get(ends, i))).alias("denied")))).alias("out"),
    )
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<struct<name:string,denied:boolean>>").alias("out"))
    order = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.aggregate(order, start, step, lambda a: a["out"]), lambda x: x["name"] != "")


def name_sets(facts: DataFrame, group: list[str], text: str = "text", negations: list[str] | None = None) -> DataFrame:
    """One row for each group and name that its facts quote: how often said and denied, and its set; a name that is
    denied anywhere in a group is "forbidden" there, else "verified".  Counts are partial sums, so a group of any size
    is never brought together."""
    rows = facts.select(*group, F.explode(quoted_names(F.col(text), negations)).alias("q"))
    g = rows.groupBy(*group, F.col("q.name").alias("name")).agg(F.count_if(~F.col("q.denied")).alias("said"), F.count_if("q.denied").alias("denied"))
    return g.withColumn("name_set", F.when(F.col("denied") > 0, "forbidden").otherwise("verified"))


def intent_of(key: Column, rules: list[tuple[str, int, list[str]]]) -> Column:
    """(intent, matched_by) of a text's words in lower case between single blanks: rules by priority, their patterns in
    order, the first that matches; a pattern with a blank is looked for anywhere in the key, any other must be a word.
    Without a match the intent is "unknown" and matched_by null."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    out = F.struct(F.lit("unknown").alias("intent"), F.lit(None).cast("string").alias("matched_by"))
    flat = [(name, p) for name, _, patterns in sorted(rules, key=lambda r: r[1]) for p in patterns if p.strip()]
    for name, p in reversed(flat):
        hit = F.contains(key, F.lit(p)) if " " in p else F.contains(padded, F.lit(f" {p} "))
        out = F.when(hit, F.struct(F.lit(name).alias("intent"), F.lit(p).alias("matched_by"))).otherwise(out)
    return out
