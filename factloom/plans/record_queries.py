"""Queries over sources, text structure, names, signals, stability of two runs and stored records; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import assembly, dedupe, retention, rules
from factloom.plans import table_queries as T
from factloom.plans.fact_queries import _FACTS, _REASON, _TOK, _word
from factloom.plans.knowledge_queries import _FLAGS, _LAYERS, _NAMES
from factloom.sources import tables as S
from factloom.sources.tables import facts, table

#: Sources by policy; parameters of `source_reason`.
ALLOWED, BLOCKED, PATTERNS = ["src1", "src2", "src3", "src13", "src4"], ["src4"], ["src1", "9"]
#: Parts of an address that rule a page out, with what they are called.
BAD_PARTS = [("login", "account"), ("/tag/", "listing"), ("forum", "forum")]
#: English endings, longest first.
SUFFIXES = ["ing", "ed", "es", "s"]
FAMILIES = ["emergent", "tradeoff", "failure", "condition", "effect", "multi_step"]


def source_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return d.select("source", "n", F.coalesce(rules.source_reason("source", ALLOWED, BLOCKED, PATTERNS), F.lit("ok")).alias("reason"))


def url_checks(spark, sf_dir):
    """Host, language part at the end of the path, and the first reason against a page's address."""
    u = F.lower(F.trim("url"))
    reason = F.when(u.isNull() | (u == ""), "url-missing").when(~u.rlike("^https?://"), "url-scheme").when(F.regexp_extract(u, "^https?://([^/?#:]+)", 1) == "", "url-host")
    for part, name in BAD_PARTS:
        reason = reason.when(F.contains(u, F.lit(part)), f"url-{name}")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/?#:]+)", 1).alias("host"), F.regexp_extract(u, "/([a-z][a-z](-[a-z][a-z])?)/?$", 1).alias("lang_code"), reason.otherwise("ok").alias("reason"))


def structure_stats(spark, sf_dir):
    """Lines of documents by kind, and headings that stand between blank lines; arrays only, nothing is shuffled."""
    blank = lambda x: F.trim(x) == ""
    heading = lambda x: x.rlike("^(#{1,6}\\s|[A-Z][^.!?]{0,58}:$)")
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"), X.estimate_tokens("text").alias("token_estimate"), F.split("text", "\n").alias("l"))
    apart = F.filter("l", lambda x, i: heading(x) & ((i == 0) | blank(F.get(F.col("l"), i - 1))) & ((i == F.size("l") - 1) | blank(F.get(F.col("l"), i + 1))))
    kinds = {"n_lines": F.size("l"), "n_blank": F.size(F.filter("l", blank)), "n_heading": F.size(F.filter("l", heading)), "n_list": F.size(F.filter("l", lambda x: x.rlike("^\\s*([-*]|[0-9]+[.)])\\s"))), "n_apart": F.size(apart)}
    return d.select("doc_id", "chars", "token_estimate", *[c.cast("bigint").alias(k) for k, c in kinds.items()])


def merged_paragraphs(spark, sf_dir):
    """Token counts of paragraphs after small ones went to the one before."""
    p = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: X.estimate_tokens(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p).cast("bigint").alias("before"), assembly.merge_tiny(p).alias("sizes"))


def title_contexts(spark, sf_dir):
    """What stands around the first word of a page's title in the page."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", X.context_window("html", "title").alias("around"))


def final_sentences(spark, sf_dir):
    """Turns up to their last sentence end; those without one get a full stop."""
    t = F.trim("text")
    cut = F.regexp_extract(t, "(?s)^(.*[.!?])", 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t == "", "").when(cut == "", F.concat(t, F.lit("."))).otherwise(cut).alias("text"))


def stem_counts(spark, sf_dir):
    """Words without their longest known ending, of which two letters at least must stay."""
    c = table(spark, sf_dir, "conversations").select(F.explode(X.tokens("text", 1)).alias("w"))
    stem = F.col("w")
    for s in reversed(SUFFIXES):
        stem = F.when(F.endswith("w", F.lit(s)) & (F.length("w") >= len(s) + 2), F.substr("w", F.lit(1), F.length("w") - len(s))).otherwise(stem)
    return c.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("w").alias("n_forms"))


def candidate_counts(spark, sf_dir):
    """Names by how often they stand anywhere and how often at the start of a sentence; one that never stands
    elsewhere is no sure name."""
    c = table(spark, sf_dir, "conversations")
    starts = F.regexp_extract_all("text", F.lit("(?:^|[.!?]\\s+)(\\p{Lu}[\\p{L}\\p{N}'-]{2,}(?:\\s+\\p{Lu}[\\p{L}\\p{N}'-]{2,})*)"), F.lit(1))
    both = c.select(F.explode(assembly.names("text")).alias("name"), F.lit(0).alias("s")).unionByName(c.select(F.explode(starts).alias("name"), F.lit(1).alias("s")))
    g = both.groupBy("name").agg(F.count_if(F.col("s") == 0).alias("hits"), F.count_if(F.col("s") == 1).alias("starts"))
    return g.select("name", "hits", "starts", (F.col("hits") > F.col("starts")).alias("sure"))


def linked_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("text").rlike("(https?://|www\\.)[a-z0-9]")).alias("linked"))


def drop_reason_totals(spark, sf_dir):
    """Reasons in all, from partial counts by source."""
    part = rules.with_flags(facts(spark, sf_dir)).groupBy("source", F.coalesce(rules.drop_reason(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("k"))
    return part.rollup("reason").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_sources")).select(F.coalesce("reason", F.lit("all")).alias("reason"), "n", "n_sources")


def tag_matrix(spark, sf_dir):
    """Share of facts with each category, by language."""
    f = rules.with_flags(facts(spark, sf_dir))
    return f.groupBy("lang").agg(*[(F.count_if(F.col(f"m_{c}")) / F.count(F.lit(1))).alias(c) for c in FAMILIES])


def dominant_roles(spark, sf_dir):
    """The category that most facts of a source with any have, and whether 70 % of these have it."""
    f = rules.with_flags(facts(spark, sf_dir)).select("source", F.array_compact(F.array(*[F.when(F.col(f"m_{c}"), c) for c in FAMILIES])).alias("tags")).where("size(tags) > 0")
    # the few distinct lists of categories are counted before they are spread
    g = f.groupBy("source", "tags").agg(F.count(F.lit(1)).alias("k"))
    total = g.groupBy("source").agg(F.sum("k").alias("bearing"))
    role = g.select("source", "k", F.explode("tags").alias("role")).groupBy("source", "role").agg(F.sum("k").alias("n"))
    best = role.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "role")).alias("b"))
    return best.join(total, "source").select("source", F.col("b.role").alias("role"), (-F.col("b.m")).alias("n"), "bearing", (-F.col("b.m") * 10 >= F.col("bearing") * 7).alias("dominant"))


def representatives(spark, sf_dir):
    """For each language and layer the fact that scores best as deep and the one that scores best as supporting knowledge."""
    f = retention.with_retention(facts(spark, sf_dir))
    best = lambda c: F.min(F.struct((-F.col(c)).alias("s"), "doc_id", F.col("pos").cast("bigint").alias("pos")))
    g = f.groupBy("lang", "layer").agg(best("score_a").alias("a"), best("score_b").alias("b"))
    return g.select("lang", "layer", F.col("a.doc_id").alias("deep_doc"), F.col("a.pos").alias("deep_pos"), F.col("b.doc_id").alias("support_doc"), F.col("b.pos").alias("support_pos"))


def systemic_depth(spark, sf_dir):
    """Facts by depth in tenths (four for chains, four for emergent ones, two for three categories or more) and role."""
    f = rules.with_flags(facts(spark, sf_dir))
    on = lambda c: F.col(f"m_{c}").cast("int")
    spread = sum((on(c) for c in FAMILIES[1:]), on(FAMILIES[0]))
    depth = 4 * on("multi_step") + 4 * on("emergent") + F.when(spread >= 3, 2).otherwise(0)
    roles = F.array_join(F.array_compact(F.array(F.when(F.col("m_workflow"), "workflow"), F.when(F.col("m_effect") & F.col("m_condition"), "implication"), F.when(F.col("m_advice"), "operational"))), ",")
    return f.groupBy(depth.cast("bigint").alias("depth"), roles.alias("roles")).agg(F.count(F.lit(1)).alias("n"))


def utility_signals(spark, sf_dir):
    """Facts by family and confidence: a half and a tenth for each hit, 0.95 at most; in hundredths."""
    hits = [F.struct(F.lit(c).alias("family"), F.regexp_count(F.lower("fact"), F.lit(X.words_pattern(rules.LEXICON[c]))).alias("hits")) for c in FAMILIES]
    f = facts(spark, sf_dir).select(F.explode(F.filter(F.array(*hits), lambda h: h["hits"] > 0)).alias("h"))
    return f.groupBy(F.col("h.family").alias("family"), F.least(F.lit(95), 50 + 10 * F.col("h.hits")).cast("bigint").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def signature_index(spark, sf_dir):
    """Facts by their signature, the sorted categories that they have, with the languages it stands in."""
    f = rules.with_flags(facts(spark, sf_dir))
    sig = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"m_{c}"), c) for c in sorted(FAMILIES)])), "+")
    return f.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


def trace_finals(spark, sf_dir):
    """Facts by whether they are the first of their text, a later one, or empty."""
    f = facts(spark, sf_dir).select("lang", "doc_id", "pos", X.text_key("fact").alias("key"))
    g = f.where("key <> ''").groupBy("key", "lang").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    # the first of all languages' firsts is the key's; a frequent key has a row for each language here
    w = Window.partitionBy("key")
    g = g.withColumn("is_first", (F.col("first") == F.min("first").over(w)).cast("bigint"))
    return g.groupBy("lang").agg(F.sum("is_first").alias("first_n"), F.sum(F.col("n") - F.col("is_first")).alias("again_n"))


def stability_metrics(spark, sf_dir):
    """Two runs' texts: how many stayed, went and came, and the shares of these."""
    a, b = T._runs(spark, sf_dir)
    j = a.select("key", F.lit(1).alias("a")).join(b.select("key", F.lit(1).alias("b")), "key", "full")
    g = j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("stayed"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("added"))
    return g.select("stayed", "missing", "added", F.try_divide("stayed", F.col("stayed") + F.col("missing")).alias("persistence"), F.try_divide("added", F.col("missing")).alias("replacement"))


def missing_added_samples(spark, sf_dir):
    """The first five of each side."""
    w = Window.partitionBy("side").orderBy("key")
    return T.missing_added(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("side", F.col("rn").cast("bigint").alias("rn"), "key")


def continuity_scores(spark, sf_dir):
    """Benchmark items and like facts: the share of categories that either has which both have, and how many agree."""
    pairs = dedupe.rare_token_pairs(
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), X.token_set("text").alias("tokens")).where("size(tokens) > 0"),
        facts(spark, sf_dir).where("fact <> ''").groupBy(X.text_key("fact").alias("id")).agg(F.min("doc_id").alias("doc_id")).select("id", X.token_set("id").alias("tokens")).where("size(tokens) > 0"), .5,
    ).select(F.col("left_id").alias("item_id"), F.col("right_id").alias("key"))
    flags = lambda c: F.array_compact(F.array(*[F.when(rules.matches(n, c), n) for n in FAMILIES]))
    p = pairs.join(table(spark, sf_dir, "benchmark").select("item_id", flags("text").alias("x")), "item_id").withColumn("y", flags("key"))
    both, either = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return p.select("item_id", "key", both.cast("bigint").alias("shared"), either.cast("bigint").alias("either"), (len(FAMILIES) - either + both).cast("bigint").alias("agreeing"))


def mapping_safety(spark, sf_dir):
    """Mismatches in a row: how often a user's second one in a row suspends the mapping, and the longest row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T._events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad")).withColumn("run", F.count_if(~F.col("bad")).over(w))
    g = e.groupBy("user_id", "run").agg(F.count_if("bad").alias("n"))
    return g.groupBy("user_id").agg(F.count_if(F.col("n") >= 2).alias("suspended"), F.max("n").alias("longest"))


def routing_validation(spark, sf_dir):
    """Faults of a rule list, here parts: names given twice, missing names, missing patterns."""
    p = table(spark, sf_dir, "part")
    twice = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("duplicate-name").alias("fault"), "n")
    one = p.agg(*[F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(n) for n, c in (("missing-name", "p_name"), ("missing-pattern", "p_type"))]).unpivot([], ["missing-name", "missing-pattern"], "fault", "n")
    return twice.unionByName(one)


def trim_previews(spark, sf_dir):
    """The text of each segment of a prompt after its cap and its share of the trimming.

    Of the turns of a segment only those that begin within its cap are brought together, so what is gathered is
    bounded however long a conversation is.
    """
    seg = F.create_map(*[F.lit(x) for r, s in (("system", T.SEGMENTS[0]), ("assistant", T.SEGMENTS[1]), ("user", T.SEGMENTS[2])) for x in (r, s[1])])
    cap = F.create_map(*[F.lit(x) for s in T.SEGMENTS for x in (s[1], s[2])])
    c = table(spark, sf_dir, "conversations").select("conv_id", seg[F.col("role")].cast("bigint").alias("trim_order"), "turn", "text")
    w = Window.partitionBy("conv_id", "trim_order").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)
    most = cap[F.col("trim_order").cast("int")]
    c = c.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).where(F.col("before") < most).withColumn("text", F.substr("text", F.lit(1), (most - F.col("before")).cast("int")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "before", "text"))), lambda t: t["text"]), "")
    whole = c.groupBy("conv_id", "trim_order").agg(text.alias("text"))
    return whole.join(T.prompt_trim(spark, sf_dir), ["conv_id", "trim_order"]).select("conv_id", "trim_order", F.substr("text", F.lit(1), (F.col("chars") - F.col("trimmed")).cast("int")).alias("text"))


def page_mappings(spark, sf_dir):
    """Titles with hosts, both trimmed and both there: the first two hundred, as many as a mapping list holds."""
    p = table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"))
    return p.where("title <> '' AND host <> ''").orderBy("page_id").limit(200)


def request_states(spark, sf_dir):
    """Orders as requests: open ones stay so, others are resolved when their last line was shipped."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"), F.count(F.lit(1)).alias("n_lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(last, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("state"), F.when(F.col("o_orderstatus") != "O", F.date_format("shipped", "yyyy-MM-dd")).alias("resolved_on"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def review_decisions(spark, sf_dir):
    """Customers with the last decision on them; without one they are pending."""
    e = T._events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")).groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(e, "c_custkey", "left").select("c_custkey", F.when(F.col("last") == "purchase", "approved").when(F.col("last") == "error", "rejected").otherwise("pending").alias("decision"))


def recent_events(spark, sf_dir):
    """Events of the last seven days before the newest one."""
    e = T._events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("as_of"))
    return S.keep_recent(e.crossJoin(F.broadcast(last)), "ts", F.col("as_of"), 7).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))  # one row


def salvaged_props(spark, sf_dir):
    """Properties that stand inside other text, by value."""
    noisy = F.concat(F.lit("note: "), "props", F.lit(" end"))
    e = table(spark, sf_dir, "events").select(S.salvage_json(noisy, "struct<k: bigint>")["k"].alias("k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (source_checks, url_checks, structure_stats, merged_paragraphs, title_contexts, final_sentences, stem_counts, candidate_counts, linked_texts, drop_reason_totals, tag_matrix, dominant_roles, representatives, systemic_depth, utility_signals, signature_index, trace_finals, stability_metrics, missing_added_samples, continuity_scores, mapping_safety, routing_validation, trim_previews, page_mappings, request_states, review_decisions, recent_events, salvaged_props)}

_HOST = "regexp_extract({0}, '^https?://([^/?#:]+)', 1)"
_LOW = "lower(trim(url))"
_HEAD = "regexp_matches(x, '^(#{1,6}\\s|[A-Z][^.!?]{0,58}:$)')"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_STOP = ["that", "this", "with", "from", "when", "will", "your"]
_FLAGGED = f"{_FACTS}, fl AS (SELECT *, {_FLAGS} FROM facts)"
_TAGS = "list_filter([{0}], lambda x: x IS NOT NULL)"
_SPREAD = " + ".join(f"CAST(m_{c} AS INT)" for c in FAMILIES)


def _flag_list(column: str) -> str:
    return _TAGS.format(", ".join(f"CASE WHEN {_word(c).replace('lower(fact)', f'lower({column})')} THEN '{c}' END" for c in FAMILIES))


SQL = {
    "source_checks": f"SELECT source, count(*) AS n, CASE WHEN source IS NULL OR trim(source) = '' THEN 'source-type-missing' WHEN lower(trim(source)) IN ('src4') THEN 'source-type-blocked' WHEN {' OR '.join(f'''contains(lower(trim(source)), '{p}')''' for p in PATTERNS)} THEN 'source-type-pattern' WHEN lower(trim(source)) NOT IN ({', '.join(map(repr, ALLOWED))}) THEN 'source-type-not-allowed' ELSE 'ok' END AS reason FROM documents GROUP BY source",
    "url_checks": f"SELECT page_id, {_HOST.format(_LOW)} AS host, regexp_extract({_LOW}, '/([a-z][a-z](-[a-z][a-z])?)/?$', 1) AS lang_code, CASE WHEN url IS NULL OR trim(url) = '' THEN 'url-missing' WHEN NOT regexp_matches({_LOW}, '^https?://') THEN 'url-scheme' WHEN {_HOST.format(_LOW)} = '' THEN 'url-host' {' '.join(f'''WHEN contains({_LOW}, '{p}') THEN 'url-{n}' ''' for p, n in BAD_PARTS)} ELSE 'ok' END AS reason FROM pages",
    "structure_stats": f"WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, length(text) AS chars, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END AS BIGINT) AS token_estimate, len(l) AS n_lines, len(list_filter(l, lambda x: trim(x) = '')) AS n_blank, len(list_filter(l, lambda x: {_HEAD})) AS n_heading, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*([-*]|[0-9]+[.)])\\s'))) AS n_list, len(list_filter(l, lambda x, i: {_HEAD} AND (i = 1 OR trim(l[i - 1]) = '') AND (i = len(l) OR trim(l[i + 1]) = ''))) AS n_apart FROM d",
    "title_contexts": f"WITH p AS (SELECT page_id, html, list_filter({_TOK.format(_TITLE, 4)}, lambda t: contains(lower(html), t) AND NOT list_contains({_STOP}, t)) AS h FROM pages), q AS (SELECT *, instr(lower(html), h[1]) AS hit FROM p) SELECT page_id, CASE WHEN len(h) > 0 THEN substr(html, greatest(1, hit - 140), hit - greatest(1, hit - 140) + 140) END AS around FROM q",
    "final_sentences": "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN '' WHEN regexp_extract(trim(text), '(?s)^(.*[.!?])', 1) = '' THEN trim(text) || '.' ELSE regexp_extract(trim(text), '(?s)^(.*[.!?])', 1) END AS text FROM conversations",
    "stem_counts": f"WITH w AS (SELECT unnest({_TOK.format('text', 1)}) AS w FROM conversations) SELECT CASE " + " ".join(f"WHEN suffix(w, '{s}') AND length(w) >= {len(s) + 2} THEN left(w, length(w) - {len(s)})" for s in SUFFIXES) + " ELSE w END AS stem, count(*) AS n, count(DISTINCT w) AS n_forms FROM w GROUP BY 1",
    "candidate_counts": f"WITH b AS (SELECT unnest({_NAMES.format('text')}) AS name, 0 AS s FROM conversations UNION ALL SELECT unnest(regexp_extract_all(text, '(?:^|[.!?]\\s+)(\\p{{Lu}}[\\p{{L}}\\p{{N}}''-]{{2,}}(?:\\s+\\p{{Lu}}[\\p{{L}}\\p{{N}}''-]{{2,}})*)', 1)), 1 FROM conversations) SELECT name, count_if(s = 0) AS hits, count_if(s = 1) AS starts, count_if(s = 0) > count_if(s = 1) AS sure FROM b GROUP BY 1",
    "linked_texts": r"SELECT lang, count(*) AS n, count_if(regexp_matches(lower(text), '(https?://|www\.)[a-z0-9]')) AS linked FROM documents GROUP BY 1",
    "drop_reason_totals": f"WITH {_FACTS}, p AS (SELECT source, coalesce({_REASON}, 'kept') AS reason, count(*) AS k FROM facts GROUP BY 1, 2) SELECT coalesce(reason, 'all') AS reason, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_sources FROM p GROUP BY ROLLUP (reason)",
    "tag_matrix": f"WITH {_FLAGGED} SELECT lang, " + ", ".join(f"count_if(m_{c}) / count(*) AS {c}" for c in FAMILIES) + " FROM fl GROUP BY 1",
    "dominant_roles": f"WITH {_FLAGGED}, r AS (SELECT source, doc_id, pos, {_TAGS.format(', '.join(f'''CASE WHEN m_{c} THEN '{c}' END''' for c in FAMILIES))} AS tags FROM fl), t AS (SELECT source, count(*) AS bearing FROM r WHERE len(tags) > 0 GROUP BY 1), n AS (SELECT source, role, count(*) AS n FROM (SELECT source, unnest(tags) AS role FROM r) GROUP BY 1, 2), b AS (SELECT source, arg_min(role, (-n, role)) AS role, max(n) AS n FROM n GROUP BY 1) SELECT source, role, n, bearing, n * 10 >= bearing * 7 AS dominant FROM b JOIN t USING (source)",
    "representatives": f"WITH {_LAYERS} SELECT lang, layer, arg_min(doc_id, (-score_a, doc_id, pos)) AS deep_doc, arg_min(pos, (-score_a, doc_id, pos)) AS deep_pos, arg_min(doc_id, (-score_b, doc_id, pos)) AS support_doc, arg_min(pos, (-score_b, doc_id, pos)) AS support_pos FROM la GROUP BY 1, 2",
    "systemic_depth": f"WITH {_FLAGGED} SELECT CAST(4 * CAST(m_multi_step AS INT) + 4 * CAST(m_emergent AS INT) + CASE WHEN {_SPREAD} >= 3 THEN 2 ELSE 0 END AS BIGINT) AS depth, concat_ws(',', CASE WHEN m_workflow THEN 'workflow' END, CASE WHEN m_effect AND m_condition THEN 'implication' END, CASE WHEN m_advice THEN 'operational' END) AS roles, count(*) AS n FROM fl GROUP BY 1, 2",
    "utility_signals": f"WITH {_FACTS}, h AS (" + " UNION ALL ".join(rf"SELECT '{c}' AS family, len(regexp_extract_all(lower(fact), '\b({'|'.join(rules.LEXICON[c])})\b')) AS hits FROM facts" for c in FAMILIES) + ") SELECT family, CAST(least(95, 50 + 10 * hits) AS BIGINT) AS confidence, count(*) AS n FROM h WHERE hits > 0 GROUP BY 1, 2",
    "signature_index": f"WITH {_FLAGGED} SELECT concat_ws('+', {', '.join(f'''CASE WHEN m_{c} THEN '{c}' END''' for c in sorted(FAMILIES))}) AS signature, count(*) AS n, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM fl GROUP BY 1",
    "trace_finals": f"WITH {_FACTS} SELECT lang, CAST(count_if(rn = 1) AS BIGINT) AS first_n, CAST(count_if(rn > 1) AS BIGINT) AS again_n FROM (SELECT lang, row_number() OVER (PARTITION BY lower(fact) ORDER BY doc_id, pos) AS rn FROM facts WHERE fact <> '') GROUP BY 1",
    "stability_metrics": f"WITH {T._RUNS}, g AS (SELECT count_if(x.key IS NOT NULL AND y.key IS NOT NULL) AS stayed, count_if(y.key IS NULL) AS missing, count_if(x.key IS NULL) AS added FROM a x FULL JOIN b y ON x.key = y.key) SELECT *, stayed / nullif(stayed + missing, 0) AS persistence, added / nullif(missing, 0) AS replacement FROM g",
    "missing_added_samples": "SELECT side, rn, key FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY key) AS rn FROM (" + T.SQL["missing_added"] + ")) WHERE rn <= 5",
    "continuity_scores": f"WITH {_FACTS}, k AS (SELECT DISTINCT lower(fact) AS key FROM facts WHERE fact <> ''), r AS (SELECT key, list_distinct({_TOK.format('key', 3)}) AS t FROM k), b AS (SELECT item_id, text, list_distinct({_TOK.format('text', 3)}) AS t FROM benchmark), p AS (SELECT item_id, key, {_flag_list('text')} AS x, {_flag_list('key')} AS y FROM b JOIN r ON list_has_any(b.t, r.t) AND len(list_intersect(b.t, r.t)) >= 0.5 * (len(b.t) + len(r.t) - len(list_intersect(b.t, r.t)))) SELECT item_id, key, len(list_intersect(x, y)) AS shared, len(x) + len(y) - len(list_intersect(x, y)) AS either, {len(FAMILIES)} - len(x) - len(y) + 2 * len(list_intersect(x, y)) AS agreeing FROM p",
    "mapping_safety": "WITH e AS (SELECT user_id, event_type = 'error' AS bad, count_if(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events), g AS (SELECT user_id, run, count_if(bad) AS n FROM e GROUP BY 1, 2) SELECT user_id, count_if(n >= 2) AS suspended, max(n) AS longest FROM g GROUP BY 1",
    "routing_validation": "SELECT 'duplicate-name' AS fault, count_if(k > 1) AS n FROM (SELECT count(*) AS k FROM part GROUP BY p_name) UNION ALL SELECT 'missing-name', count_if(p_name IS NULL OR trim(p_name) = '') FROM part UNION ALL SELECT 'missing-pattern', count_if(p_type IS NULL OR trim(p_type) = '') FROM part",
    "trim_previews": "WITH w AS (SELECT conv_id, CAST(CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS BIGINT) AS trim_order, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY 1, 2) SELECT conv_id, trim_order, substr(text, 1, chars - trimmed) AS text FROM w JOIN (" + T.SQL["prompt_trim"] + ") USING (conv_id, trim_order)",
    "page_mappings": f"SELECT page_id, trim({_TITLE}) AS title, {_HOST.format('url')} AS host FROM pages WHERE trim({_TITLE}) <> '' AND {_HOST.format('url')} <> '' ORDER BY page_id LIMIT 200",
    "request_states": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS state, CASE WHEN o_orderstatus <> 'O' THEN strftime(shipped, '%Y-%m-%d') END AS resolved_on, coalesce(n_lines, 0) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "review_decisions": "SELECT c_custkey, CASE last WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS decision FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) ON c_custkey = user_id",
    "recent_events": "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY 1",
    "salvaged_props": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
}
