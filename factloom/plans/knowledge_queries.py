"""Queries over retention layers, chunk budgets, links, names, rules and replacements; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import assembly, dedupe, retention, rules
from factloom.plans import table_queries as T
from factloom.plans.fact_queries import _FACTS, _REASON, _TOK, _word
from factloom.sources.tables import facts, table

#: Rules whose effect on the number of kept facts is compared, by lexicon category.
COMPARED = [("tutorial-pattern", ["tutorial"]), ("generic-pattern", ["generic"]), ("lore-pattern", ["lore"]), ("time-bound-metadata", ["time_bound", "!emergent", "!tradeoff"]), ("advice", ["advice", "!effect"])]
#: Answers by language; English stands in where there is none.
ANSWERS = {"en": "No record.", "de": "Kein Eintrag.", "es": "Sin registro."}


def retention_layers(spark, sf_dir):
    f = retention.with_retention(facts(spark, sf_dir))
    return f.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "score_a", "score_b", "layer")


def retention_terms(spark, sf_dir):
    """Which terms made the scores, by layer."""
    f = retention.with_retention(facts(spark, sf_dir)).select("layer", F.explode("terms_a").alias("t"))
    return f.groupBy("layer", F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.sum("t.points").alias("points"))


def layer_diagnostics(spark, sf_dir):
    """Shares by language and layer, and a composite of three of them."""
    f = retention.with_retention(facts(spark, sf_dir))
    g = f.groupBy("lang", "layer").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"m_{c}")).alias(c) for c in ("effect", "condition", "emergent", "failure")], F.sum("score_a").alias("points"))
    return g.select("lang", "layer", "n", (F.col("effect") / F.col("n")).alias("effect_share"), (F.col("emergent") / F.col("n")).alias("emergent_share"), (F.col("points") / F.col("n")).alias("mean_score"), ((3 * F.col("emergent") + 2 * F.col("failure") + F.col("condition")) / (6 * F.col("n"))).alias("composite"))


def section_density(spark, sf_dir):
    """Kept facts for each thousand estimated tokens, by source."""
    f = rules.with_flags(facts(spark, sf_dir)).groupBy("source").agg(F.count_if(rules.drop_reason().isNull()).alias("kept"), F.sum(X.estimate_tokens("fact")).alias("tokens"))
    return f.where("tokens > 0").select("source", "kept", "tokens", (F.col("kept") * 1000 / F.col("tokens")).alias("density"))


def dropped_by_tag(spark, sf_dir):
    """Facts with and without each category, and how many of either were dropped; categories overlap."""
    f = rules.with_flags(facts(spark, sf_dir)).select(rules.drop_reason().isNotNull().alias("gone"), F.explode(F.array(*[F.struct(F.lit(c).alias("tag"), F.col(f"m_{c}").alias("on")) for c in sorted(rules.LEXICON)])).alias("t"))
    on, gone = F.col("t.on"), F.col("gone")
    return f.groupBy(F.col("t.tag").alias("tag")).agg(F.count_if(on).alias("with_tag"), F.count_if(on & gone).alias("with_dropped"), F.count_if(~on).alias("without_tag"), F.count_if(~on & gone).alias("without_dropped"))


def counterfactual_drops(spark, sf_dir):
    """Facts dropped by any compared rule, and how many would be if one of the rules were off."""
    f = rules.with_flags(facts(spark, sf_dir)).select(retention.failed_rules(COMPARED).alias("failed"))
    one = F.explode(F.array(*[F.lit(n) for n, _ in COMPARED]))
    # the few distinct combinations are counted first, so the rules are spread over these and not over all facts
    g = f.groupBy("failed").agg(F.count(F.lit(1)).alias("k")).select("failed", "k", one.alias("rule"))
    return g.groupBy("rule").agg(F.sum(F.when(F.size("failed") > 0, F.col("k")).otherwise(0)).alias("baseline"), F.sum(F.when(F.size(F.array_remove("failed", F.col("rule"))) > 0, F.col("k")).otherwise(0)).alias("simulated"))


def loss_taxonomy(spark, sf_dir):
    """Texts that only the first of two runs has, by the first category of theirs."""
    a, b = T._runs(spark, sf_dir)
    lost = rules.with_flags(a.join(b, "key", "left_anti").withColumnRenamed("key", "fact"))
    kind = F.coalesce(*[F.when(F.col(f"m_{c}"), c) for c in ("emergent", "failure", "tradeoff", "condition", "effect")], F.lit("other"))
    return lost.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("facts"))


def replacement_candidates(spark, sf_dir):
    """For each text that only the first run has, the most alike of those that only the second has, if half or more
    is shared; the first by key on equal shares."""
    *sides, source = T.apart(spark, sf_dir)
    left, right = (x.select(F.col("key").alias("id"), X.token_set("key").alias("tokens")).where("size(tokens) > 0") for x in sides)
    return dedupe.best_matches(left, right, .5, source)


def notable_deltas(spark, sf_dir):
    return T.snapshot_diff(spark, sf_dir).where("level <> 'stable'").orderBy(F.abs("delta").desc(), "metric").limit(25)


def bucketed_lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", X.bucketize(F.col("n_chars") / 4096).alias("bucket"))
    return d.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))


def chunk_budget(spark, sf_dir):
    """Chunks of each document after the cheapest neighbours were merged down to ten, up to 1500 tokens each."""
    d = T.packed_documents(spark, sf_dir).select("doc_id", F.size("chunks").cast("bigint").alias("before"), assembly.merge_cheapest(F.col("chunks")).alias("c"))
    return d.select("doc_id", "before", F.size("c").cast("bigint").alias("after"), F.array_max("c").alias("largest"))


def _links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    first = lambda p: X.token_set(F.regexp_extract("html", p, 1))
    lexicon = F.array(*[F.lit(w) for c in ("emergent", "tradeoff", "condition") for w in rules.LEXICON[c] if len(w) >= 3])
    signals = p.select("page_id", first("<title>([^<]*)</title>").alias("title"), first("<h1>([^<]*)</h1>").alias("heading"), X.token_set(F.array_join(F.regexp_extract_all("html", F.lit("<h2>([^<]*)</h2>"), F.lit(1)), " ")).alias("subheading"), X.token_set(F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1)).alias("path"))
    found = T.site_links(spark, sf_dir).join(signals, "page_id")
    return found.select("page_id", "url", assembly.link_score(F.col("text"), F.col("url"), {n: F.col(n) for n in ("title", "heading", "subheading", "path")} | {"lexicon": lexicon}).alias("score"))


def link_scores(spark, sf_dir):
    return _links(spark, sf_dir)


def followed_links(spark, sf_dir):
    """A page's best ten links that score enough; where none does, its best three of the lower bar."""
    w = Window.partitionBy("page_id")
    r = _links(spark, sf_dir).withColumns({"good": F.count_if(F.col("score") >= assembly.LEAST_SCORE).over(w), "rn": F.row_number().over(w.orderBy(F.col("score").desc(), "url"))})
    good = (F.col("score") >= assembly.LEAST_SCORE) & (F.col("rn") <= assembly.MOST_LINKS)
    poor = (F.col("good") == 0) & (F.col("score") >= assembly.FALLBACK_SCORE) & (F.col("rn") <= assembly.FALLBACK_LINKS)
    return r.where(good | poor).select("page_id", "url", "score", F.col("rn").cast("bigint").alias("rn"))


def mentionables(spark, sf_dir):
    """Names by their folded form: the first spelling and where it stands."""
    n = facts(spark, sf_dir).select("doc_id", "pos", F.posexplode(assembly.names("fact")).alias("i", "name"))
    g = n.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("doc_id", "pos", "i", "name")).alias("first"), F.count(F.lit(1)).alias("n"))
    return g.select("key", F.col("first.name").alias("name"), F.col("first.doc_id").alias("doc_id"), "n")


def _offenders(spark, sf_dir):
    """Names in answers that no user turn of the conversation has, by turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(assembly.names("text"))).alias("name"))
    said = c.where("role = 'user'").select("conv_id", "name").distinct()
    return c.where("role <> 'user'").join(said, ["conv_id", "name"], "left_anti").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("name")).alias("offenders"))


def whitelist_names(spark, sf_dir):
    o = _offenders(spark, sf_dir)
    return o.select("conv_id", "turn", F.size("offenders").cast("bigint").alias("n"), F.array_join("offenders", ",").alias("offenders"))


def redacted_turns(spark, sf_dir):
    """Answers with each name that was not allowed made unreadable."""
    c = table(spark, sf_dir, "conversations").where("role <> 'user'").join(_offenders(spark, sf_dir), ["conv_id", "turn"], "left")
    return c.select("conv_id", "turn", assembly.redact(F.col("text"), F.coalesce("offenders", F.array().cast("array<string>"))).alias("text"))


def open_requests(spark, sf_dir):
    """Requests that are added because no open one has the same key: the first of each key."""
    o = table(spark, sf_dir, "orders").withColumn("key", F.concat_ws("|", F.col("o_custkey").cast("string"), X.text_key("o_orderpriority")))
    new = o.where("o_orderstatus = 'P'").groupBy("key").agg(F.min("o_orderkey").alias("o_orderkey"), F.count(F.lit(1)).alias("asked"))
    return new.join(o.where("o_orderstatus = 'O'").select("key"), "key", "left_anti")


def duplicate_registrations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang", F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return d.where("n > 1")


def answer_templates(spark, sf_dir):
    """Documents by the answer of their language, English where there is none."""
    t = F.create_map(*[F.lit(x) for kv in ANSWERS.items() for x in kv])
    return table(spark, sf_dir, "documents").groupBy("lang", F.coalesce(F.get(F.map_values(F.map_filter(t, lambda k, _: k == F.col("lang"))), F.lit(0)), F.lit(ANSWERS["en"])).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def stage_spans(spark, sf_dir):
    """Microseconds from a user's last view to the purchase after it; a purchase without one has none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T._events(spark, sf_dir).where(F.col("event_type").isin("view", "purchase")).withColumns({"before": F.lag("event_type").over(w), "since": F.lag("ts").over(w)})
    return e.where("event_type = 'purchase'").select("event_id", F.when(F.col("before") == "view", F.unix_micros("ts") - F.unix_micros("since")).alias("elapsed"))


def rule_report(spark, sf_dir):
    """Turns that each intent's words match, alone and together with an earlier intent's."""
    hits = [F.lower("text").rlike(X.words_pattern(w)) for _, _, w in T.INTENTS]
    rows = [F.struct(F.lit(n).alias("intent"), h.alias("hit"), (h & F.exists(F.array(F.lit(False), *hits[:k]), lambda x: x)).alias("hidden")) for k, ((n, _, _), h) in enumerate(zip(T.INTENTS, hits, strict=True))]
    c = table(spark, sf_dir, "conversations").select(F.explode(F.array(*rows)).alias("r"))
    return c.groupBy(F.col("r.intent").alias("intent")).agg(F.count_if("r.hit").alias("hits"), F.count_if("r.hidden").alias("hidden"))


QUERIES = {f.__name__: f for f in (retention_layers, retention_terms, layer_diagnostics, section_density, dropped_by_tag, counterfactual_drops, loss_taxonomy, replacement_candidates, notable_deltas, bucketed_lengths, chunk_budget, link_scores, followed_links, mentionables, whitelist_names, redacted_turns, open_requests, duplicate_registrations, answer_templates, stage_spans, rule_report)}


def _cond(names: list[str]) -> str:
    return " AND ".join(f"NOT {_word(n[1:])}" if n[0] == "!" else _word(n) for n in names)


def _sum(parts: list) -> str:
    return "(" + " + ".join(f"CASE WHEN {_cond(c)} THEN {p} ELSE 0 END" for _, c, p in parts) + ")"


_GONE = f"(({_REASON}) IS NOT NULL)"


_FLAGS = ", ".join(f"{_word(c)} AS m_{c}" for c in rules.LEXICON)
_LAYERS = f"{_FACTS}, sc AS (SELECT doc_id, pos, lang, fact, {_FLAGS}, CAST({_sum(retention.DEEP)} AS BIGINT) AS score_a, CAST({_sum(retention.SUPPORT)} AS BIGINT) AS score_b FROM facts), la AS (SELECT *, CASE WHEN ((m_emergent OR m_tradeoff) AND m_effect) OR score_a >= score_b THEN 'A' ELSE 'B' END AS layer FROM sc)"
_NAMES = "regexp_extract_all({0}, '" + assembly.NAME.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', 1)"
_SETS = {"title": "title", "heading": "heading", "subheading": "subheading", "path": "path", "lexicon": str([w for c in ("emergent", "tradeoff", "condition") for w in rules.LEXICON[c] if len(w) >= 3])}
_LINKS = (
    "WITH s AS (SELECT page_id, " + ", ".join(f"list_distinct({_TOK.format(x, 3)}) AS {n}" for n, x in (("title", "regexp_extract(html, '<title>([^<]*)</title>', 1)"), ("heading", "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"), ("subheading", "array_to_string(regexp_extract_all(html, '<h2>([^<]*)</h2>', 1), ' ')"), ("path", "regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1)")))
    + f" FROM pages), l AS (SELECT page_id, url, text, {_TOK.format('text', 3)} AS o, list_distinct(list_concat({_TOK.format('text', 3)}, {_TOK.format('url', 3)})) AS t FROM (" + T.SQL["site_links"] + ")), j AS (SELECT l.*, s.* EXCLUDE (page_id) FROM l JOIN s USING (page_id)), sc AS (SELECT page_id, url, CAST(CASE WHEN len(t) = 0 THEN 0 ELSE least(100, "
    + " + ".join(f"len(list_intersect(t, {_SETS[n]})) * {w}" for n, w in assembly.SIGNALS) + " + CASE WHEN length(text) >= 8 THEN 5 ELSE 0 END + CASE WHEN len(o) >= 2 THEN 5 ELSE 0 END) END AS BIGINT) AS score FROM j)"
)
_HITS = [rf"regexp_matches(lower(text), '\b({'|'.join(w)})\b')" for _, _, w in T.INTENTS]
_KINDS = ("emergent", "failure", "tradeoff", "condition", "effect")

SQL = {
    "retention_layers": f"WITH {_LAYERS} SELECT doc_id, pos, score_a, score_b, layer FROM la",
    "retention_terms": f"WITH {_LAYERS} " + " UNION ALL ".join(f"SELECT layer, '{n}' AS term, count(*) AS n, CAST(count(*) * {p} AS BIGINT) AS points FROM la WHERE {_cond(c)} GROUP BY 1" for n, c, p in retention.DEEP),
    "layer_diagnostics": f"WITH {_LAYERS}, g AS (SELECT lang, layer, count(*) AS n, count_if(m_effect) AS e, count_if(m_condition) AS c, count_if(m_emergent) AS m, count_if(m_failure) AS f, CAST(sum(score_a) AS BIGINT) AS p FROM la GROUP BY 1, 2) SELECT lang, layer, n, e / n AS effect_share, m / n AS emergent_share, p / n AS mean_score, (3 * m + 2 * f + c) / (6 * n) AS composite FROM g",
    "section_density": f"WITH {_FACTS} SELECT source, kept, tokens, kept * 1000 / tokens AS density FROM (SELECT source, count_if(NOT {_GONE}) AS kept, CAST(sum(CASE WHEN length(fact) = 0 THEN 0 ELSE greatest(1, ceil(length(fact) / 4.0)) END) AS BIGINT) AS tokens FROM facts GROUP BY 1) WHERE tokens > 0",
    "dropped_by_tag": f"WITH {_FACTS}, g AS (SELECT *, {_GONE} AS gone, {_FLAGS} FROM facts) " + " UNION ALL ".join(f"SELECT '{c}' AS tag, count_if(m_{c}) AS with_tag, count_if(m_{c} AND gone) AS with_dropped, count_if(NOT m_{c}) AS without_tag, count_if(NOT m_{c} AND gone) AS without_dropped FROM g" for c in sorted(rules.LEXICON)),
    "counterfactual_drops": f"WITH {_FACTS}, g AS (SELECT " + ", ".join(f"({_cond(c)}) AS r{k}" for k, (_, c) in enumerate(COMPARED)) + " FROM facts) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count_if({' OR '.join(f'r{j}' for j in range(len(COMPARED)))}) AS baseline, count_if({' OR '.join(f'r{j}' for j in range(len(COMPARED)) if j != k)}) AS simulated FROM g" for k, (n, _) in enumerate(COMPARED)),
    "loss_taxonomy": f"WITH {T._RUNS}, l AS (SELECT key AS fact, n FROM a ANTI JOIN b USING (key)) SELECT CASE " + " ".join(f"WHEN {_word(c)} THEN '{c}'" for c in _KINDS) + " ELSE 'other' END AS kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS facts FROM l GROUP BY 1",
    "notable_deltas": "SELECT * FROM (" + T.SQL["snapshot_diff"] + ") WHERE level <> 'stable' ORDER BY abs(delta) DESC, metric LIMIT 25",
    "bucketed_lengths": "SELECT source, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars / 4096 < 0.2 THEN '0.0-0.2' WHEN n_chars / 4096 < 0.4 THEN '0.2-0.4' WHEN n_chars / 4096 < 0.6 THEN '0.4-0.6' WHEN n_chars / 4096 < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n FROM documents GROUP BY 1, 2",
    "link_scores": _LINKS + " SELECT page_id, url, score FROM sc",
    "followed_links": _LINKS + ", r AS (SELECT *, count_if(score >= 12) OVER (PARTITION BY page_id) AS good, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS rn FROM sc) SELECT page_id, url, score, rn FROM r WHERE (score >= 12 AND rn <= 10) OR (good = 0 AND score >= 5 AND rn <= 3)",
    "mentionables": f"WITH {_FACTS}, w AS (SELECT doc_id, pos, {_NAMES.format('fact')} AS w FROM facts), n AS (SELECT doc_id, pos, unnest(w) AS name, unnest(range(len(w))) AS i FROM w) SELECT lower(name) AS key, arg_min(name, (doc_id, pos, i)) AS name, min(doc_id) AS doc_id, count(*) AS n FROM n GROUP BY 1",
    "whitelist_names": f"WITH c AS (SELECT conv_id, turn, role, unnest(list_distinct({_NAMES.format('text')})) AS name FROM conversations) SELECT conv_id, turn, count(*) AS n, string_agg(name, ',' ORDER BY name) AS offenders FROM c WHERE role <> 'user' AND NOT EXISTS (SELECT 1 FROM c u WHERE u.role = 'user' AND u.conv_id = c.conv_id AND u.name = c.name) GROUP BY 1, 2",
    "open_requests": "WITH o AS (SELECT *, o_custkey || '|' || trim(lower(o_orderpriority)) AS key FROM orders) SELECT key, min(o_orderkey) AS o_orderkey, count(*) AS asked FROM o WHERE o_orderstatus = 'P' AND key NOT IN (SELECT key FROM o WHERE o_orderstatus = 'O') GROUP BY 1",
    "duplicate_registrations": "SELECT lang, md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "answer_templates": "SELECT lang, CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ANSWERS.items()) + f" ELSE '{ANSWERS['en']}' END AS answer, count(*) AS n FROM documents GROUP BY 1, 2",
    "stage_spans": "SELECT event_id, CASE WHEN b = 'view' THEN epoch_us(ts) - epoch_us(t) END AS elapsed FROM (SELECT *, lag(event_type) OVER w AS b, lag(ts) OVER w AS t FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase'",
    "rule_report": " UNION ALL ".join(f"SELECT '{n}' AS intent, count_if({h}) AS hits, count_if({h} AND ({' OR '.join(['false', *_HITS[:k]])})) AS hidden FROM conversations" for k, ((n, _, _), h) in enumerate(zip(T.INTENTS, _HITS, strict=True))),
}
