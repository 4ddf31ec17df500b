"""Queries over events, conversations, lookups, pages, vectors and two runs; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import context, dedupe
from factloom.plans.fact_queries import _FACTS, _TOK
from factloom.sources import tables as S
from factloom.sources.tables import facts, table
from factloom.streaming import usage as U

# Intents by priority and the words that tell them.
INTENTS = [("greeting", 1, ["hello", "thanks"]), ("howto", 2, ["how", "explain", "write"]), ("fact", 3, ["what", "which", "who"]), ("prose", 4, ["the", "and"])]
SEGMENTS = [("history", 1, 6000), ("facts", 2, 8000), ("question", 3, 4000)]  # trim order and cap; the last is required
PROMPT_CHARS = 12000
#: What is searched in the history, folded as the entries are.
SEARCHED = "Íng"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def throttle_gaps(spark, sf_dir):
    """Events that come two hours or more after the user's one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumn("before", F.lag("ts").over(w))
    return e.where(F.col("before").isNull() | (F.unix_micros("ts") - F.unix_micros("before") >= 7_200_000_000)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def usage_counters(spark, sf_dir):
    return U.usage(_events(spark, sf_dir))


def stream_usage(spark, sf_dir):
    return U.usage_from_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", f"{sf_dir.rstrip('/')}/event[s].parquet").select("user_id", "total", "purchases", "errors", "last_event_id", "last_event_type")


def hot_score(spark, sf_dir):
    """Users by use, decayed over fourteen days from the newest event: score in units of a 14th."""
    e = _events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("as_of"))
    u = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("high"), F.max("ts").alias("seen"))
    days = F.floor((F.unix_micros("as_of") - F.unix_micros("seen")) / 86_400_000_000).cast("bigint")
    s = u.crossJoin(F.broadcast(last)).withColumn("days", days)  # one row
    return s.select("user_id", "total", "days", ((F.col("total") + 2 * F.col("high")) * F.greatest(F.lit(7), 14 - F.col("days"))).cast("bigint").alias("score14")).orderBy(F.col("score14").desc(), "user_id").limit(10)


def ring_last_n(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return _events(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 1000").select("event_type", "event_id", F.col("rn").cast("bigint").alias("rn"))


def frame_windows(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("micros", F.unix_micros("ts"))
    return e.groupBy(F.floor(F.col("micros") / 3_600_000_000).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("worst"), F.count_if(F.col("value") >= 34).alias("janky"))


def latency_p95_split(spark, sf_dir):
    """Mean and nearest-rank 95th percentile, by type and parity of the property.

    The mean is of whole thousandths, so that no order of adding changes it; a missing value counts 0 there.
    Counts over whole numbers tell between which two the percentile lies; only values between these are ordered.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = _events(spark, sf_dir).select("event_type", (k % 2 == 0).alias("even"), "value", F.floor("value").alias("bin"))
    by = ["event_type", "even"]
    bins = e.where("value IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("k"), F.max("value").alias("most"))
    w = Window.partitionBy(*by)
    bins = bins.withColumns({"through": F.sum("k").over(w.orderBy("bin")), "rank": F.ceil(F.sum("k").over(w) * 0.95)})
    cut = bins.where((F.col("through") >= F.col("rank")) & (F.col("through") - F.col("k") < F.col("rank"))).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bin").alias("_bin"), (F.col("rank") - F.col("through") + F.col("k")).alias("left"))
    same = F.col("event_type").eqNullSafe(F.col("_event_type")) & F.col("even").eqNullSafe(F.col("_even"))
    inside = e.join(F.broadcast(cut), same & (F.col("bin") == F.col("_bin"))).groupBy(*by, "left", "value").agg(F.count(F.lit(1)).alias("k"))  # a row for each pair of type and parity
    p95 = inside.withColumn("through", F.sum("k").over(w.orderBy("value"))).where("through >= left").groupBy(*by).agg(F.min("value").alias("p95"))
    all_ = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("worst"), F.sum(F.coalesce(F.floor(F.col("value") * 1000 + 0.5), F.lit(0))).alias("thousandths"))
    p95 = p95.select(*[F.col(c).alias(f"_{c}") for c in by], "p95")
    return all_.join(p95, same, "left").select(*by, "n", (F.col("thousandths") / (F.col("n") * 1000)).alias("mean"), "p95", "worst")


def intent_breakdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.max("turn").alias("last_turn"))


def budget_summary(spark, sf_dir):
    """The total row, and the eight types of events with the largest means: how many, mean and largest value.  Means are as
    in latency_p95_split."""
    thousandths = F.sum(F.coalesce(F.floor(F.col("value") * 1000 + 0.5), F.lit(0)))
    g = _events(spark, sf_dir).rollup("event_type").agg(F.grouping("event_type").alias("whole"), F.count(F.lit(1)).alias("n"), (thousandths / (F.count(F.lit(1)) * 1000)).alias("mean"), F.max("value").alias("most"))
    top = g.orderBy(F.col("whole").desc(), F.col("mean").desc(), "event_type").limit(9)
    return top.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("event_type")).alias("event_type"), "n", "mean", "most")


def context_state(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("name", F.when(F.col("event_type") != "error", F.col("event_type")))
    return context.context_states(e)


def positional_pairs(spark, sf_dir):
    """The n-th last click of a user beside the n-th last view."""
    def ranked(kind, col):
        w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
        return _events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(col), F.row_number().over(w).cast("bigint").alias("place"))
    return ranked("click", "click_id").join(ranked("view", "view_id"), ["user_id", "place"])


def freshest_before(spark, sf_dir):
    """Each purchase with the user's last view of the 24 hours before it: an as-of lookup with a tolerance."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = _events(spark, sf_dir).withColumn("seen", F.last(F.when(F.col("event_type") == "view", F.struct("ts", "event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase'").select("event_id", F.when(F.unix_micros("ts") - F.unix_micros("seen.ts") <= 86_400_000_000, F.col("seen.event_id")).alias("view_id"))


def tier_lookup(spark, sf_dir):
    """Customers by the tier of their nation: A before B before the default."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tier = n.select("n_nationkey", F.when(F.col("r_name").isin("ASIA", "EUROPE"), "A").when(F.col("r_name") == "AMERICA", "B").otherwise("C").alias("tier"))
    return table(spark, sf_dir, "customer").join(F.broadcast(tier), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("tier", F.lit("C")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def alias_lookup(spark, sf_dir):
    """Pages by the first alias that their host's first label equals."""
    alias = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.explode(F.array(F.lower("n_name"), F.concat(F.lit("site"), F.col("n_nationkey").cast("string")))).alias("alias"))
    host = F.regexp_extract("url", "^https?://([a-z0-9]+)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", host.alias("alias"))
    return p.join(F.broadcast(alias), "alias", "left").groupBy("page_id").agg(F.min("pos").cast("bigint").alias("pos"))


def prefix_map(spark, sf_dir):
    """Part types by the longest listed prefix."""
    listed = table(spark, sf_dir, "part").select(F.explode(F.array(F.substring("p_type", 1, 3), F.substring("p_type", 1, 5))).alias("prefix")).distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"), "p_type").select("p_partkey", F.substring("p_type", 1, F.col("n")).alias("prefix"))
    return p.join(listed, "prefix").groupBy("p_partkey").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def registry_match(spark, sf_dir):
    """The first registered pattern, by order, that a turn's text matches."""
    expr = F.lit(None).cast("string")
    for name, _, words in reversed(INTENTS):
        expr = F.when(F.lower("text").rlike(X.words_pattern(words)), name).otherwise(expr)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", expr.alias("name")).where("name IS NOT NULL")


def classify_intent(spark, sf_dir):
    t = X.token_set("text", 1)
    expr = F.lit("unknown")
    for name, _, words in sorted(INTENTS, key=lambda i: -i[1]):
        expr = F.when(F.arrays_overlap(t, F.array(*map(F.lit, words))), name).otherwise(expr)
    return table(spark, sf_dir, "conversations").select("role", expr.alias("intent")).groupBy("role", "intent").agg(F.count(F.lit(1)).alias("n"))


def score_facts_topk(spark, sf_dir):
    """For each benchmark item its three best facts: two points a shared token of five letters, by place on ties."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.token_set("text", 5)).alias("t"))
    f = facts(spark, sf_dir).select("doc_id", "pos", F.explode(X.token_set("fact", 5)).alias("t"))
    s = f.join(q, "t").groupBy("item_id", "doc_id", "pos").agg((2 * F.count(F.lit(1))).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id", "pos")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("item_id", "doc_id", F.col("pos").cast("bigint").alias("pos"), "score", F.col("rn").cast("bigint").alias("rn"))


def prompt_trim(spark, sf_dir):
    """Segments of a conversation by role, capped and then trimmed in a fixed order until the prompt fits."""
    seg = F.create_map(*[F.lit(x) for r, s in (("system", SEGMENTS[0]), ("assistant", SEGMENTS[1]), ("user", SEGMENTS[2])) for x in (r, s[1])])
    cap = F.create_map(*[F.lit(x) for s in SEGMENTS for x in (s[1], s[2])])
    c = table(spark, sf_dir, "conversations").select("conv_id", seg[F.col("role")].alias("trim_order"), F.length("text").alias("n")).groupBy("conv_id", "trim_order").agg(F.sum("n").alias("n"))
    c = c.withColumn("chars", F.least(F.col("n"), cap[F.col("trim_order")].cast("bigint")))
    w = Window.partitionBy("conv_id")
    over = F.greatest(F.sum("chars").over(w) - PROMPT_CHARS, F.lit(0))
    before = F.coalesce(F.sum("chars").over(w.orderBy("trim_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("conv_id", F.col("trim_order").cast("bigint").alias("trim_order"), "chars", F.least(F.col("chars"), F.greatest(F.lit(0), over - before)).alias("trimmed"))


def history_search(spark, sf_dir, needle=SEARCHED):
    """Entries of each conversation, a question with its answer, and how many of them a search finds."""
    said = lambda role: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("entry")).agg(said("user").alias("question"), said("assistant").alias("answer"))
    return c.withColumn("hit", X.found_in("question", "answer", needle)).groupBy("conv_id").agg(F.count_if("hit").alias("visible"), F.count(F.lit(1)).alias("total"))


def idempotent_append(spark, sf_dir):
    """Newest first and at most 500 entries, after adding those orders whose id the finished ones lack."""
    o = table(spark, sf_dir, "orders")
    have, add = o.where("o_orderstatus = 'F'"), o
    both = have.unionByName(add.join(have.select("o_orderkey"), "o_orderkey", "left_anti"))
    return both.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(500).select("o_orderkey", "o_custkey")


def upsert_templates(spark, sf_dir):
    """Full outer merge of finished and other orders on the customer; a new row's value wins where it has one:
    the last order of a price of 100000 or more."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("old_k"))
    new = o.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.max(F.when(F.col("o_totalprice") >= 100000, F.col("o_orderkey"))).alias("new_k"))
    return old.join(new, "o_custkey", "full").select("o_custkey", F.coalesce("new_k", "old_k").alias("k"), F.col("old_k").isNull().alias("is_new"))


def split_rates(spark, sf_dir):
    """Overlapping groups of labelled documents: hits and totals of each."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    groups = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "kept": (F.col("quality") == 1) & (F.col("toxic") == 0), "long": F.col("n_chars") >= 2000}
    g = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in groups.items()])
    rates = g.select("lang", "n", *[X.rate(F.col(k), F.col("n")).alias(k) for k in groups])
    return rates.select("lang", "n", *[x for k in groups for x in (F.col(f"{k}.hits").alias(k), F.col(f"{k}.rate").alias(f"{k}_rate"))])


def bucket_rates(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    b = F.when(F.col("n_chars") < 500, "low").when(F.col("n_chars") < 2000, "mid").otherwise("high")
    return d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("dropped"))


def survival_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    m = d.groupBy("lang").pivot("quality", [0, 1]).agg(F.count(F.lit(1)))
    return m.select("lang", F.coalesce("0", F.lit(0)).alias("dropped"), F.coalesce("1", F.lit(0)).alias("kept"))


def chunk_cohesion(spark, sf_dir):
    """Per document the facts, distinct tokens and its most frequent token."""
    t = facts(spark, sf_dir).select("doc_id", F.explode(X.token_set("fact", 4)).alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.min(F.struct((-F.col("n")).alias("m"), "t")).alias("b")).select("doc_id", "n_tokens", F.col("b.t").alias("top"), (-F.col("b.m")).alias("top_n"))


def _runs(spark, sf_dir):
    f = facts(spark, sf_dir).where("fact <> ''").withColumn("key", X.text_key("fact"))
    # each run is used several times: its texts are split and counted once
    return (S.written(f.where(F.col("doc_id") % 2 == k).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "run") for k in (0, 1))


def apart(spark, sf_dir):
    """Texts that only the first run has, and those that only the second has, and the table that both are read from: one
    pass over the facts."""
    f = facts(spark, sf_dir).where("fact <> '' AND doc_id % 2 IN (0, 1)").groupBy(X.text_key("fact").alias("key"))
    f = f.agg(F.min(F.col("doc_id") % 2).alias("first"), F.max(F.col("doc_id") % 2).alias("last")).where("first = last")
    f = S.written(f.select("key", F.col("first").alias("run")), "apart")
    return f.where("run = 0").select("key"), f.where("run = 1").select("key"), f


def missing_added(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    return a.join(b, "key", "left_anti").select("key", F.lit("missing").alias("side")).unionByName(b.join(a, "key", "left_anti").select("key", F.lit("added").alias("side")))


def matched_signatures(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    return a.join(b.select("key", F.col("doc_id").alias("doc_b"), F.col("n").alias("n_b")), "key").select("key", "doc_id", "doc_b", "n", "n_b")


def per_source_full_outer(spark, sf_dir):
    f = facts(spark, sf_dir)
    a, b = (f.where(F.col("doc_id") % 2 == k).groupBy("source", "lang").agg(F.count(F.lit(1)).alias(c)) for k, c in ((0, "before"), (1, "after")))
    return a.join(b, ["source", "lang"], "full").select("source", "lang", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def snapshot_diff(spark, sf_dir):
    """Metrics of two runs, their difference and its level; whole numbers go by count thresholds."""
    d = table(spark, sf_dir, "documents")
    def run(k, c):
        r = d.where(F.col("doc_id") % 2 == k).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
        return r.unpivot("lang", ["docs", "chars", "longest"], "metric", c).select(F.concat_ws(".", F.lit("metrics"), "lang", "metric").alias("metric"), F.col(c).cast("bigint").alias(c))
    j = run(0, "before").join(run(1, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))
    level = F.when(F.abs("delta") >= 1000, "break").when(F.abs("delta") >= 100, "regression").when(F.abs("delta") >= 10, "notable").when(F.abs("delta") >= 1, "minor").otherwise("stable")
    return j.select("metric", "before", "after", "delta", level.alias("level"))


def equivalence_best_match(spark, sf_dir):
    """For facts that only the first run has, the best of those that only the second has, by shared rare tokens."""
    *sides, source = apart(spark, sf_dir)
    left, right = (x.select(F.col("key").alias("id"), X.token_set("key", 4).alias("tokens")).where("size(tokens) >= 2") for x in sides)
    return dedupe.best_matches(left, right, .5, source)


def leader_clusters(spark, sf_dir):
    return dedupe.leader_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def cosine_to_first(spark, sf_dir):
    """Vectors that are like their label's first vector."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("lead"), F.min("vec_id").alias("lead_id"))
    return e.join(first, "label").where("vec_id <> lead_id").select("vec_id", "lead_id", (X.cosine("embedding", "lead") >= .5).alias("alike"))


def links_of(spark, sf_dir, html):
    """Links in html as whole addresses on the page's own host: the first of each, with its text without tags, and
    how many there are."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page"), html.alias("body"))
    found = F.regexp_extract_all("body", F.lit('(?is)(<a [^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    links = p.select("page_id", "page", F.posexplode(found).alias("pos", "a")).select("page_id", "page", "pos", F.trim(F.regexp_extract("a", '(?is)href="([^"]*)"', 1)).alias("href"), X.collapse(F.regexp_replace("a", "<[^>]*>", " ")).alias("text"))
    links = links.where("href <> '' AND href NOT RLIKE '(?i)^(#|javascript:|mailto:)'").withColumn("url", F.regexp_replace(S.absolute_url("href", "page"), "#.*$", ""))
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#:]+)", 1))
    return links.where(host("url") == host("page")).groupBy("page_id", "url").agg(F.min_by("text", "pos").alias("text"), F.count(F.lit(1)).alias("n"))


def page_links(spark, sf_dir):
    """Links of article bodies."""
    return links_of(spark, sf_dir, S.article_body("html"))


def site_links(spark, sf_dir):
    """Links of whole pages, navigation too."""
    return links_of(spark, sf_dir, F.col("html"))


def page_text(spark, sf_dir):
    """Article bodies as text: characters, lines and headings of each page."""
    t = table(spark, sf_dir, "pages").select("page_id", S.markup_text(S.article_body("html")).alias("text"))
    return t.select("page_id", F.length("text").cast("bigint").alias("chars"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"), "text")


def heading_levels(spark, sf_dir):
    """Lines of page texts that are headings, with their confidence and level: hashes by their number, numbered ones 2."""
    lines = page_text(spark, sf_dir).select("page_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    strong = F.col("line").rlike("^\\s*(#{1,6}\\s+\\S|\\d+(?:\\.\\d+)*[.)]?\\s+\\S)")
    level = F.when(F.length(F.regexp_extract("line", "^(#{1,6})\\s", 1)) > 0, F.length(F.regexp_extract("line", "^(#{1,6})\\s", 1))).when(F.col("line").rlike("^\\s*\\d+(?:\\.\\d+)*[.)]?\\s+\\S"), 2)
    h = lines.withColumn("confidence", X.heading_confidence("line")).where(strong | (F.col("confidence") >= .55))
    return h.select("page_id", F.col("pos").cast("bigint").alias("pos"), level.cast("bigint").alias("level"), (F.col("confidence") * 100).cast("bigint").alias("confidence"), F.regexp_replace("line", "^(#+|\\s*\\d+(?:\\.\\d+)*[.)]?)\\s*", "").alias("title"))


def page_sections(spark, sf_dir):
    """Sections of pages: a new one at each heading line, with its path of headings above."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(S.markup_text(S.article_body("html")), "\n")).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", "^(#{1,6})\\s", 1))
    w = Window.partitionBy("page_id").orderBy("pos")
    marked = lines.withColumns({"level": level, "section": F.sum(F.when(level > 0, 1).otherwise(0)).over(w)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    s = marked.groupBy("page_id", "section").agg(F.max("level").alias("depth"), F.max(F.when(F.col("level") > 0, F.regexp_replace("line", "^#+\\s*", ""))).alias("heading"), text.alias("text"))
    v = Window.partitionBy("page_id").orderBy("section")
    for k in range(1, 7):
        # a shallower heading ends the deeper ones
        s = s.withColumn(f"h{k}", F.last(F.when(F.col("depth") == k, F.concat(F.lit("+"), F.coalesce("heading", F.lit("")))).when((F.col("depth") > 0) & (F.col("depth") < k), F.lit("-")), ignorenulls=True).over(v))
    path = F.transform(F.filter(F.array(*[f"h{k}" for k in range(1, 7)]), lambda h: h.startswith("+")), lambda h: F.substr(h, F.lit(2)))
    return s.select("page_id", F.col("section").cast("bigint").alias("section"), "depth", "heading", F.array_join(path, " > ").alias("section_path"), X.estimate_tokens("text").alias("token_estimate"))


def packed_documents(spark, sf_dir):
    """doc_id and token counts of chunks: sentences packed greedily up to 500 tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "(?<=[.!?])\\s+").alias("s"))
    acc = F.aggregate(F.transform("s", lambda x: X.estimate_tokens(x)), F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("open")), lambda a, n: F.when((a["open"] > 0) & (a["open"] + n > 500), F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), n.alias("open"))).otherwise(F.struct(a["done"].alias("done"), (a["open"] + n).alias("open"))))
    return d.select("doc_id", acc.alias("a")).select("doc_id", F.concat("a.done", F.array("a.open")).alias("chunks"))


def document_chunks(spark, sf_dir):
    """Sentences packed greedily into chunks of at most 500 tokens."""
    return packed_documents(spark, sf_dir).select("doc_id", F.posexplode("chunks").alias("chunk", "tokens")).select("doc_id", (F.col("chunk") + 1).cast("bigint").alias("chunk_id"), "tokens")


QUERIES = {f.__name__: f for f in (throttle_gaps, usage_counters, stream_usage, hot_score, ring_last_n, frame_windows, latency_p95_split, intent_breakdown, budget_summary, context_state, positional_pairs, freshest_before, tier_lookup, alias_lookup, prefix_map, registry_match, classify_intent, score_facts_topk, prompt_trim, history_search, idempotent_append, upsert_templates, split_rates, bucket_rates, survival_matrix, chunk_cohesion, missing_added, matched_signatures, per_source_full_outer, snapshot_diff, equivalence_best_match, leader_clusters, cosine_to_first, page_links, site_links, page_text, heading_levels, page_sections, document_chunks)}

_US = "epoch_us(ts)"
_USAGE = "SELECT user_id, count(*) AS total, count_if(event_type = 'purchase') AS purchases, count_if(event_type = 'error') AS errors, arg_max(event_id, (ts, event_id)) AS last_event_id, arg_max(event_type, (ts, event_id)) AS last_event_type FROM events GROUP BY 1"
_RUNS = f"{_FACTS}, a AS (SELECT lower(fact) AS key, min(doc_id) AS doc_id, count(*) AS n FROM facts WHERE fact <> '' AND doc_id % 2 = 0 GROUP BY 1), b AS (SELECT lower(fact) AS key, min(doc_id) AS doc_id, count(*) AS n FROM facts WHERE fact <> '' AND doc_id % 2 = 1 GROUP BY 1)"
_REGISTRY = "CASE " + " ".join(rf"WHEN regexp_matches(lower(text), '\b({'|'.join(w)})\b') THEN '{n}'" for n, _, w in INTENTS) + " END"
_INTENT = "CASE " + " ".join(f"WHEN list_has_any({_TOK.format('text', 1)}, {w}) THEN '{n}'" for n, _, w in INTENTS) + " ELSE 'unknown' END"

SQL = {
    "throttle_gaps": f"SELECT user_id, count(*) AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR epoch_us(ts) - epoch_us(b) >= 7200000000 GROUP BY 1",
    "usage_counters": _USAGE, "stream_usage": _USAGE,
    "hot_score": "SELECT user_id, total, days, CAST((total + 2 * high) * greatest(7, 14 - days) AS BIGINT) AS score14 FROM (SELECT user_id, count(*) AS total, count_if(event_type = 'purchase') AS high, CAST(floor(((SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts))) / 86400000000) AS BIGINT) AS days FROM events GROUP BY 1) ORDER BY score14 DESC, user_id LIMIT 10",
    "ring_last_n": "SELECT event_type, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 1000",
    "frame_windows": f"SELECT CAST(floor({_US} / 3600000000) AS BIGINT) AS hour, count(*) AS n, max(value) AS worst, count_if(value >= 34) AS janky FROM events GROUP BY 1",
    "latency_p95_split": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS even, count(*) AS n, CAST(sum(coalesce(CAST(floor(value * 1000 + 0.5) AS BIGINT), 0)) AS DOUBLE) / (count(*) * 1000) AS mean, quantile_disc(value, 0.95) AS p95, max(value) AS worst FROM events GROUP BY 1, 2",
    "intent_breakdown": "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations GROUP BY 1",
    "budget_summary": "SELECT CASE WHEN whole = 1 THEN 'all' ELSE event_type END AS event_type, n, mean, most FROM (SELECT event_type, grouping(event_type) AS whole, count(*) AS n, CAST(sum(coalesce(CAST(floor(value * 1000 + 0.5) AS BIGINT), 0)) AS DOUBLE) / (count(*) * 1000) AS mean, max(value) AS most FROM events GROUP BY ROLLUP (event_type)) ORDER BY whole DESC, mean DESC, event_type NULLS FIRST LIMIT 9",
    "positional_pairs": "WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT c.user_id, c.place, c.event_id AS click_id, v.event_id AS view_id FROM r c JOIN r v ON c.user_id = v.user_id AND c.place = v.place AND c.event_type = 'click' AND v.event_type = 'view'",
    "freshest_before": "WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type = 'view' THEN epoch_us(ts) END IGNORE NULLS) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, CASE WHEN epoch_us(ts) - t <= 86400000000 THEN v END AS view_id FROM e WHERE event_type = 'purchase'",
    "tier_lookup": "SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'A' WHEN r_name = 'AMERICA' THEN 'B' ELSE 'C' END AS tier, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "alias_lookup": "WITH a AS (SELECT n_nationkey AS pos, lower(n_name) AS alias FROM nation UNION ALL SELECT n_nationkey, 'site' || n_nationkey FROM nation) SELECT page_id, CAST(min(pos) AS BIGINT) AS pos FROM pages LEFT JOIN a ON regexp_extract(url, '^https?://([a-z0-9]+)', 1) = alias GROUP BY 1",
    "prefix_map": "WITH l AS (SELECT substr(p_type, 1, 3) AS prefix FROM part UNION SELECT substr(p_type, 1, 5) FROM part) SELECT p_partkey, arg_max(prefix, length(prefix)) AS prefix FROM part JOIN l ON starts_with(p_type, prefix) GROUP BY 1",
    "registry_match": f"SELECT conv_id, turn, {_REGISTRY} AS name FROM conversations WHERE {_REGISTRY} IS NOT NULL",
    "classify_intent": f"SELECT role, {_INTENT} AS intent, count(*) AS n FROM conversations GROUP BY 1, 2",
    "score_facts_topk": f"WITH {_FACTS}, q AS (SELECT item_id, unnest(list_distinct({_TOK.format('text', 5)})) AS t FROM benchmark), f AS (SELECT doc_id, pos, unnest(list_distinct({_TOK.format('fact', 5)})) AS t FROM facts), s AS (SELECT item_id, doc_id, pos, 2 * count(*) AS score FROM q JOIN f USING (t) GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, pos) AS rn FROM s) WHERE rn <= 3",
    "prompt_trim": f"WITH c AS (SELECT conv_id, CAST(CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS BIGINT) AS trim_order, sum(length(text)) AS n FROM conversations GROUP BY 1, 2), d AS (SELECT conv_id, trim_order, CAST(least(n, CASE trim_order WHEN 1 THEN 6000 WHEN 2 THEN 8000 ELSE 4000 END) AS BIGINT) AS chars FROM c) SELECT conv_id, trim_order, chars, CAST(least(chars, greatest(0, greatest(sum(chars) OVER (PARTITION BY conv_id) - {PROMPT_CHARS}, 0) - coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY trim_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS trimmed FROM d",
    "history_search": f"WITH c AS (SELECT conv_id, turn // 2 AS entry, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') || ' ' || coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS said FROM conversations GROUP BY 1, 2) SELECT conv_id, count_if(contains(trim(regexp_replace(strip_accents(lower(said)), '\\s+', ' ', 'g')), strip_accents(lower('{SEARCHED}')))) AS visible, count(*) AS total FROM c GROUP BY 1",
    "idempotent_append": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500",
    "upsert_templates": "WITH x AS (SELECT o_custkey, max(o_orderkey) AS old_k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), y AS (SELECT o_custkey, max(CASE WHEN o_totalprice >= 100000 THEN o_orderkey END) AS new_k FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT o_custkey, coalesce(new_k, old_k) AS k, old_k IS NULL AS is_new FROM x FULL JOIN y USING (o_custkey)",
    "split_rates": "WITH g AS (SELECT lang, count(*) AS n, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic, count_if(quality = 1 AND toxic = 0) AS kept, count_if(n_chars >= 2000) AS long FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT *, " + ", ".join(f"floor(({k} * 2000 + n) / (n * 2)) / 1000 AS {k}_rate" for k in ("good", "toxic", "kept", "long")) + " FROM g",
    "bucket_rates": "SELECT CASE WHEN n_chars < 500 THEN 'low' WHEN n_chars < 2000 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, count_if(quality = 0) AS dropped FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "survival_matrix": "SELECT lang, count_if(quality = 0) AS dropped, count_if(quality = 1) AS kept FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "chunk_cohesion": f"WITH {_FACTS}, t AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({_TOK.format('fact', 4)})) AS t FROM facts) GROUP BY 1, 2) SELECT doc_id, count(*) AS n_tokens, arg_min(t, (-n, t)) AS top, max(n) AS top_n FROM t GROUP BY 1",
    "missing_added": f"WITH {_RUNS} SELECT key, 'missing' AS side FROM a ANTI JOIN b USING (key) UNION ALL SELECT key, 'added' FROM b ANTI JOIN a USING (key)",
    "matched_signatures": f"WITH {_RUNS} SELECT key, a.doc_id, b.doc_id AS doc_b, a.n, b.n AS n_b FROM a JOIN b USING (key)",
    "per_source_full_outer": f"WITH {_FACTS} SELECT source, lang, count_if(doc_id % 2 = 0) AS before, count_if(doc_id % 2 = 1) AS after FROM facts GROUP BY 1, 2",
    "snapshot_diff": "WITH m AS (SELECT doc_id % 2 AS run, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY 1, 2), u AS (SELECT run, 'metrics.' || lang || '.' || metric AS metric, v FROM m UNPIVOT (v FOR metric IN (docs, chars, longest))), j AS (SELECT a.metric, a.v AS before, b.v AS after, b.v - a.v AS delta FROM u a JOIN u b ON a.metric = b.metric AND a.run = 0 AND b.run = 1) SELECT *, CASE WHEN abs(delta) >= 1000 THEN 'break' WHEN abs(delta) >= 100 THEN 'regression' WHEN abs(delta) >= 10 THEN 'notable' WHEN abs(delta) >= 1 THEN 'minor' ELSE 'stable' END AS level FROM j",
    "site_links": r"""WITH p AS (SELECT page_id, url AS page, regexp_extract_all(html, '(?is)(<a [^>]*href="[^"]*"[^>]*>.*?</a>)', 1) AS a FROM pages), l AS (SELECT page_id, page, unnest(a) AS a, unnest(range(len(a))) AS pos FROM p),
      h AS (SELECT page_id, page, pos, trim(regexp_extract(a, '(?is)href="([^"]*)"', 1)) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM l),
      u AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(page, '^([A-Za-z]+://[^/?#]*)', 1) || href ELSE regexp_replace(regexp_replace(page, '[?#].*$', ''), '[^/]*$', '') || href END, '#.*$', '') AS url FROM h WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(#|javascript:|mailto:)'))
      SELECT page_id, url, arg_min(text, pos) AS text, count(*) AS n FROM u WHERE lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) = lower(regexp_extract(page, '^[A-Za-z]+://([^/?#:]+)', 1)) GROUP BY 1, 2""",
    "cosine_to_first": "WITH f AS (SELECT label, min(vec_id) AS lead_id, arg_min(embedding, vec_id) AS lead FROM embeddings GROUP BY 1) SELECT vec_id, lead_id, list_cosine_similarity(embedding::DOUBLE[], lead::DOUBLE[]) >= 0.5 AS alike FROM embeddings JOIN f USING (label) WHERE vec_id <> lead_id",
}
