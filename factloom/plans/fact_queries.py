"""Queries over candidate facts: filters, scores, keys, dedupe, counts; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import dedupe, rules
from factloom.sources.tables import facts, table

_FACTS = r"""facts AS (SELECT doc_id, lang, source, pos, raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS fact FROM (
  SELECT doc_id, lang, source, unnest(p) AS raw, unnest(range(len(p))) AS pos FROM (SELECT *, coalesce(string_split_regex(text, '[.!?]+\s+'), [NULL]::VARCHAR[]) AS p FROM documents)))"""
_TOK = r"list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= {1})"


def _word(c: str) -> str:
    return r"regexp_matches(lower(fact), '\b(" + "|".join(rules.LEXICON[c]) + r")\b')"


#: Length in UTF-16 code units.
_UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"

_GUARD = f"({_word('emergent')} OR {_word('tradeoff')})"
_REASON = f"""CASE WHEN fact IS NULL OR fact = '' THEN 'missing-text' WHEN length(fact) > {rules.MAX_CHARS} THEN 'text-too-long'
 WHEN contains(lower(fact), 'lore') OR contains(lower(fact), 'story') THEN 'lore-pattern' WHEN {_word('tutorial')} THEN 'tutorial-pattern' WHEN {_word('generic')} THEN 'generic-pattern'
 WHEN {_word('time_bound')} AND NOT {_GUARD} THEN 'time-bound-metadata' WHEN len(list_distinct({_TOK.format('fact', 4)})) < 2 AND NOT {_GUARD} THEN 'low-signal' END"""


def flagged(spark, sf_dir):
    return rules.with_flags(facts(spark, sf_dir))


def fact_drop_histogram(spark, sf_dir):
    f = flagged(spark, sf_dir).withColumn("reason", F.coalesce(rules.drop_reason(), F.lit("kept")))
    return f.groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


def kept_fact_flagship(spark, sf_dir):
    """Kept facts of each source, the three longest with their counts of hits."""
    f = flagged(spark, sf_dir).where(rules.drop_reason().isNull()).withColumn("n_tokens", F.size(X.token_set("fact")).cast("bigint"))
    w = Window.partitionBy("source").orderBy(F.col("n_tokens").desc(), "doc_id", "pos")
    return f.select("source", "doc_id", F.col("pos").cast("bigint").alias("pos"), "fact", "n_tokens", F.row_number().over(w).cast("bigint").alias("rn")).where("rn <= 3")


def score_steps(spark, sf_dir):
    """How often each score step applied to kept facts, by language."""
    f = rules.with_scores(flagged(spark, sf_dir).where(rules.drop_reason().isNull()))
    # the few distinct lists of steps are counted before they are spread
    g = f.select("lang", F.col("score_steps.step").alias("steps")).groupBy("lang", "steps").agg(F.count(F.lit(1)).alias("k"))
    return g.select("lang", "k", F.explode("steps").alias("step")).groupBy("lang", "step").agg(F.sum("k").alias("n"))


def _step_sql() -> str:
    flags = {c: _word(c) for c in rules.LEXICON} | {"specific": f"len(list_distinct({_TOK.format('fact', 5)})) >= 2"}
    parts = []
    for name, cats, _, _ in rules.STEPS:
        cond = " AND ".join(f"NOT {flags[c[1:]]}" if c[0] == "!" else flags[c] for c in cats)
        parts.append(f"SELECT lang, '{name}' AS step, count(*) AS n FROM kept WHERE {cond} GROUP BY lang")
    return f"WITH {_FACTS}, kept AS (SELECT * FROM facts WHERE {_REASON} IS NULL) " + " UNION ALL ".join(parts)


def _priority_sql() -> str:
    """The steps one inside the other: each adds what applies and is clamped."""
    flags = {c: _word(c) for c in rules.LEXICON} | {"specific": f"len(list_distinct({_TOK.format('fact', 5)})) >= 2"}
    n, o = "CAST(0.5 AS DOUBLE)", "CAST(0.4 AS DOUBLE)"
    for k, (_, _, dn, do) in enumerate(rules.STEPS):
        n, o = (f"least(1, greatest(0, {v} + CASE WHEN s{k} THEN CAST({d} AS DOUBLE) ELSE 0 END))" for v, d in ((n, dn), (o, do)))
    on = ", ".join("(" + " AND ".join(f"NOT {flags[c[1:]]}" if c[0] == "!" else flags[c] for c in cats) + f") AS s{k}" for k, (_, cats, _, _) in enumerate(rules.STEPS))
    return f"WITH {_FACTS}, st AS (SELECT lang, {on} FROM facts WHERE {_REASON} IS NULL), sc AS (SELECT lang, {n} AS n, {o} AS o FROM st) SELECT lang, CAST(CASE WHEN o > CAST(0.75 AS DOUBLE) THEN 1 WHEN n >= CAST(0.75 AS DOUBLE) AND o < CAST(0.4 AS DOUBLE) THEN 3 ELSE 2 END AS INT) AS priority, count(*) AS n FROM sc GROUP BY 1, 2"


def fact_priorities(spark, sf_dir):
    """Facts by language and final priority."""
    f = rules.with_scores(flagged(spark, sf_dir).where(rules.drop_reason().isNull()))
    p = rules.final_priority(F.lit(2), F.col("novelty"), F.col("obviousness"))
    return f.groupBy("lang", p.cast("int").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def text_keys(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.select("doc_id", F.col("pos").cast("bigint").alias("pos"), X.text_key("raw").alias("text_key"), X.slug("raw").alias("slug"), X.word_key("raw").alias("word_key"), X.estimate_tokens("fact").alias("token_estimate"), X.sha1_id("fact").alias("sha1_id"))


def djb2_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.djb2("text").alias("djb2_id"))


def token_sets(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.array_join(F.array_sort(X.token_set("fact")), " ").alias("tokens"), F.size(X.token_set("fact")).cast("bigint").alias("n"))


def list_normalized(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(X.list_normalize(F.split("text", "[\\n,]"), 24, 8), "|").alias("entries"))


def pruned_entries(spark, sf_dir):
    """Aliases (parts of sentences) and keywords (words) of every document, pruned by length, stop terms and number."""
    d = table(spark, sf_dir, "documents")
    aliases = X.pruned(F.split("text", "[\\n,.]"), X.ALIAS_LENGTHS, X.MAX_ALIASES)
    keywords = X.pruned(F.split("text", "[\\s,.]+"), X.KEYWORD_LENGTHS, X.MAX_KEYWORDS, X.COMMON_TERMS)
    return d.select("doc_id", F.array_join(aliases, "|").alias("aliases"), F.array_join(keywords, "|").alias("keywords"))


def _pruned_sql(split: str, lengths, most: int, stop: list[str]) -> str:
    stops = ", ".join(f"'{w}'" for w in ["", *stop])
    return rf"""(WITH e AS (SELECT doc_id, unnest(p) AS v, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split_regex(text, '{split}') AS p FROM documents)),
      c AS (SELECT doc_id, i, regexp_replace(v, '^\s+|\s+$', '', 'g') AS v FROM e),
      f AS (SELECT doc_id, lower(v) AS k, arg_min(v, i) AS v, min(i) AS i FROM c WHERE v <> '' GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f WHERE {_UNITS.format('v')} BETWEEN {lengths[0]} AND {lengths[1]} AND k NOT IN ({stops}))
      SELECT d.doc_id, coalesce(string_agg(v, '|' ORDER BY i), '') AS entries FROM documents d LEFT JOIN (SELECT * FROM r WHERE rn <= {most}) r USING (doc_id) GROUP BY d.doc_id)"""


def stems_by_lang(spark, sf_dir):
    """Words of every document by language and stem: how often, and in how many forms."""
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(X.request_key("text"), " ")).alias("w")).where("w <> ''")
    # words are counted before they are cut, so each is cut once
    g = d.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("k"))
    return g.groupBy("lang", X.without_ending("w", "lang").alias("stem")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_forms"))


def _stem_sql() -> str:
    cases = " ".join(f"WHEN lang = '{c}' AND suffix(w, '{e}') AND length(w) > {len(e) + 1} THEN left(w, length(w) - {len(e)})" for c, ends in X.ENDINGS.items() for e in sorted(ends, key=len, reverse=True))
    return rf"WITH w AS (SELECT lang, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')) AS w FROM documents), g AS (SELECT lang, w, count(*) AS k FROM w WHERE w <> '' GROUP BY 1, 2) SELECT lang, CASE {cases} ELSE w END AS stem, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_forms FROM g GROUP BY 1, 2"


def exact_dedupe_merge(spark, sf_dir):
    m = dedupe.exact_merge(facts(spark, sf_dir), X.text_key("fact"), ["doc_id", "pos"])
    return m.select("key", "doc_id", F.col("pos").cast("bigint").alias("pos"), "fact", "n", "sources")


def cross_source_merge(spark, sf_dir):
    m = dedupe.exact_merge(facts(spark, sf_dir), X.word_key("fact"), ["source", "doc_id", "pos"], ["lang"]).where("size(split(sources, ',')) > 1")
    return m.select("lang", "key", F.col("source").alias("first_source"), "doc_id", "n", "sources")


def benchmark_overlap(spark, sf_dir):
    """Facts and benchmark items of token similarity 0.5 or more."""
    f = dedupe.exact_merge(facts(spark, sf_dir), X.text_key("fact"), ["doc_id", "pos"]).where("fact <> ''")
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), X.token_set("text").alias("tokens")).where("size(tokens) > 0")
    right = f.select(F.col("key").alias("id"), X.token_set("fact").alias("tokens")).where("size(tokens) > 0")
    return dedupe.rare_token_pairs(left, right, .5).select(F.col("left_id").alias("item_id"), F.col("right_id").alias("key"), "shared", "union_size")


def near_duplicate_marks(spark, sf_dir):
    return dedupe.mark_near_duplicates(facts(spark, sf_dir).where("fact <> ''"))


def pair_cooccurrence(spark, sf_dir):
    """Lexicon categories of a fact and how often two stand in one."""
    f = flagged(spark, sf_dir).select(F.array_compact(F.array(*[F.when(F.col(f"m_{c}"), c) for c in sorted(rules.LEXICON)])).alias("tags"))
    # the few distinct lists of categories are counted before they are spread
    g = f.groupBy("tags").agg(F.count(F.lit(1)).alias("k"))
    a = g.select("k", "tags", F.explode("tags").alias("a")).select("k", "a", F.explode("tags").alias("b")).where("a < b")
    return a.groupBy("a", "b").agg(F.sum("k").alias("n"))


def bundle_stats(spark, sf_dir):
    """Categories by facts and by documents."""
    f = flagged(spark, sf_dir).select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col(f"m_{c}"), c) for c in sorted(rules.LEXICON)]))).alias("tag"))
    return f.groupBy("tag").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("doc_id").alias("n_docs"))


def top_tokens(spark, sf_dir):
    f = facts(spark, sf_dir).select(F.explode(X.token_set("fact", 4)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return f.orderBy(F.col("n").desc(), "token").limit(50)


def p1_cap(spark, sf_dir):
    """Of a source's long facts, taken as top priority, only 15 % stay so where they are over 20 %.

    Facts of one length are alike here, so counts by source and length tell where the cut falls; a source's facts are
    never brought together.
    """
    by = facts(spark, sf_dir).where("fact <> ''").groupBy("source", F.length("fact").alias("chars")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("source")
    ranked = by.withColumns({"n": F.sum("k").over(w), "top": F.sum(F.when(F.col("chars") >= 60, F.col("k")).otherwise(0)).over(w), "through": F.sum("k").over(w.orderBy(F.col("chars").desc()))})
    keep = F.when(F.col("top") > F.ceil(F.col("n") * .2), F.ceil(F.col("n") * .15)).otherwise(F.col("top"))
    high = F.when(F.col("chars") >= 60, F.greatest(F.lit(0), F.least(F.col("k"), keep - F.col("through") + F.col("k")))).otherwise(0)
    rows = ranked.select("source", "chars", F.explode(F.array(F.struct(F.lit(3).alias("priority"), high.alias("k")), F.struct(F.lit(2).alias("priority"), (F.col("k") - high).alias("k")))).alias("r")).where("r.k > 0")
    return rows.groupBy("source", F.col("r.priority").alias("priority")).agg(F.sum("r.k").alias("n_facts"), F.sum(F.col("r.k") * F.col("chars")).alias("chars"))


def template_repetition(spark, sf_dir):
    """How many facts of a source begin with the same three letters more than three times."""
    f = facts(spark, sf_dir).where("fact <> ''").groupBy("source", F.substring(F.lower("fact"), 1, 3).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return f.where("n > 3").select("source", "shape", "n", (F.col("n") - 3).alias("extra"))


def review_order(spark, sf_dir):
    f = facts(spark, sf_dir).where("fact <> ''").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("fact")).cast("bigint").alias("longest"))
    return f.select("source", "lang", "n", "longest", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "lang")).cast("bigint").alias("place"))


QUERIES = {f.__name__: f for f in (fact_drop_histogram, kept_fact_flagship, score_steps, fact_priorities, text_keys, djb2_ids, token_sets, list_normalized, pruned_entries, stems_by_lang, exact_dedupe_merge, cross_source_merge, benchmark_overlap, near_duplicate_marks, pair_cooccurrence, bundle_stats, top_tokens, p1_cap, template_repetition, review_order)}

_KEY, _WKEY = "lower(fact)", r"trim(regexp_replace(lower(fact), '[^a-z0-9]+', ' ', 'g'))"
_TAGS = "(" + " UNION ALL ".join(f"SELECT doc_id, pos, '{c}' AS tag FROM facts WHERE {_word(c)}" for c in sorted(rules.LEXICON)) + ")"
_MERGE = "SELECT {0} AS key, arg_min(doc_id, ({1})) AS doc_id, arg_min(pos, ({1})) AS pos, arg_min(fact, ({1})) AS fact, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources{2} FROM facts GROUP BY {3}"

SQL = {
    "fact_drop_histogram": f"WITH {_FACTS} SELECT lang, coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM facts GROUP BY 1, 2",
    "kept_fact_flagship": f"WITH {_FACTS} SELECT * FROM (SELECT source, doc_id, pos, fact, n_tokens, row_number() OVER (PARTITION BY source ORDER BY n_tokens DESC, doc_id, pos) AS rn FROM (SELECT *, len(list_distinct({_TOK.format('fact', 3)})) AS n_tokens FROM facts WHERE {_REASON} IS NULL)) WHERE rn <= 3",
    "score_steps": _step_sql(),
    "fact_priorities": _priority_sql(),
    "text_keys": rf"WITH {_FACTS} SELECT doc_id, pos, lower(fact) AS text_key, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS word_key, CAST(ceil({_UNITS.format('fact')} / 4.0) AS BIGINT) AS token_estimate, substr(sha1(fact), 1, 12) AS sha1_id FROM facts",
    "djb2_ids": "SELECT doc_id, lower(to_hex(list_reduce(list_prepend(5381::BIGINT, flatten(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN []::BIGINT[] WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)]::BIGINT[] ELSE [unicode(c)]::BIGINT[] END))), lambda h, c: (h * 33 + c) % 4294967296))) AS djb2_id FROM documents",
    "token_sets": f"WITH {_FACTS} SELECT doc_id, pos, array_to_string(list_sort(list_distinct({_TOK.format('fact', 3)})), ' ') AS tokens, len(list_distinct({_TOK.format('fact', 3)})) AS n FROM facts",
    "pruned_entries": f"SELECT doc_id, a.entries AS aliases, k.entries AS keywords FROM {_pruned_sql('[\\n,.]', X.ALIAS_LENGTHS, X.MAX_ALIASES, [])} a JOIN {_pruned_sql('[\\s,.]+', X.KEYWORD_LENGTHS, X.MAX_KEYWORDS, X.COMMON_TERMS)} k USING (doc_id)",
    "stems_by_lang": _stem_sql(),
    "list_normalized": r"""WITH e AS (SELECT doc_id, unnest(p) AS v, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split_regex(text, '[\n,]') AS p FROM documents)),
      c AS (SELECT doc_id, i, substr(trim(regexp_replace(v, '\s+', ' ', 'g')), 1, 24) AS v FROM e),
      f AS (SELECT doc_id, lower(v) AS k, arg_min(v, i) AS v, min(i) AS i FROM c WHERE v <> '' GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
      SELECT d.doc_id, coalesce(string_agg(v, '|' ORDER BY i), '') AS entries FROM documents d LEFT JOIN (SELECT * FROM r WHERE rn <= 8) r USING (doc_id) GROUP BY d.doc_id""",
    "exact_dedupe_merge": f"WITH {_FACTS} " + _MERGE.format(_KEY, "doc_id, pos", "", "1"),
    "cross_source_merge": f"WITH {_FACTS} SELECT lang, key, first_source, doc_id, n, sources FROM (" + _MERGE.format(_WKEY, "source, doc_id, pos", ", lang, min(source) AS first_source, count(DISTINCT source) AS k", "lang, 1") + ") WHERE k > 1",
    "benchmark_overlap": f"""WITH {_FACTS}, f AS (SELECT lower(fact) AS key, list_distinct({_TOK.format('any_value(fact)', 3)}) AS t FROM facts WHERE fact <> '' GROUP BY 1), b AS (SELECT item_id, list_distinct({_TOK.format('text', 3)}) AS t FROM benchmark),
      p AS (SELECT item_id, key, len(list_intersect(b.t, f.t)) AS shared, len(b.t) + len(f.t) AS total FROM b, f WHERE len(b.t) > 0 AND len(f.t) > 0)
      SELECT item_id, key, shared, total - shared AS union_size FROM p WHERE shared >= 0.5 * (total - shared)""",
    "pair_cooccurrence": f"WITH {_FACTS}, t AS {_TAGS} SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.pos = y.pos AND x.tag < y.tag GROUP BY 1, 2",
    "bundle_stats": f"WITH {_FACTS}, t AS {_TAGS} SELECT tag, count(*) AS n_facts, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY 1",
    "top_tokens": f"WITH {_FACTS}, t AS (SELECT unnest(list_distinct({_TOK.format('fact', 4)})) AS token FROM facts) SELECT token, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 50",
    "p1_cap": f"""WITH {_FACTS}, f AS (SELECT source, doc_id, pos, length(fact) AS chars FROM facts WHERE fact <> ''),
      r AS (SELECT *, count(*) OVER w AS n, count_if(chars >= 60) OVER w AS top, row_number() OVER (PARTITION BY source ORDER BY chars DESC, doc_id, pos) AS rn FROM f WINDOW w AS (PARTITION BY source))
      SELECT source, CAST(CASE WHEN chars >= 60 AND rn <= CASE WHEN top > ceil(n * 0.2) THEN ceil(n * 0.15) ELSE top END THEN 3 ELSE 2 END AS INTEGER) AS priority, count(*) AS n_facts, CAST(sum(chars) AS BIGINT) AS chars FROM r GROUP BY 1, 2""",
    "template_repetition": f"WITH {_FACTS} SELECT source, substr(lower(fact), 1, 3) AS shape, count(*) AS n, count(*) - 3 AS extra FROM facts WHERE fact <> '' GROUP BY 1, 2 HAVING count(*) > 3",
    "review_order": f"WITH {_FACTS} SELECT source, lang, n, longest, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS place FROM (SELECT source, lang, count(*) AS n, max(length(fact)) AS longest FROM facts WHERE fact <> '' GROUP BY 1, 2)",
}
