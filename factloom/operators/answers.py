"""What goes into an answer and what comes of it: routes, modes, guards, prompt segments and redaction kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X

# Lengths from which a question is long, its commas a list, and an answer not too short, by level.
LONG_CHARS, LONG_WORDS, LIST_COMMAS = 100, 120, 8
LEAST_CHARS = {1: 120, 2: 220, 3: 360, 4: 520, 5: 700}
# Weights of priorities in retrieval.
WEIGHTS = {"P1": 1.0, "P2": 0.6, "P3": 0.3}
#: Parts of questions by what they tell, and intents and parts that are of high risk; parameters.
TROUBLE, TURNS, RISKY = ["crash", "error", "not working", "fehler"], ["as before", "continue", "earlier"], ["delete", "irreversible", "save file"]
RISKY_INTENTS = ["bug", "spoiler"]
#: What tells a place, by parts and endings; a parameter.
PLACES, PLACE_ENDINGS = ["city", "river", "forest", "stadt"], ["ville", "burg", "ton", "heim"]
#: What is said where facts do not verify an answer; a parameter.
NOTICE = {"en": "This is not verified.", "de": "Dies ist nicht belegt."}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _holds(x: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def model_reasons(text: str | Column, has_image: str | Column) -> Column:
    """Why a question needs the stronger model, in a fixed order; none for an empty question without an image."""
    t = F.coalesce(_c(text), F.lit(""))
    low, words = F.lower(t), F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    told = {
        "has-image": F.coalesce(_c(has_image), F.lit(False)), "long-input": (F.length(t) >= LONG_CHARS) | (words >= LONG_WORDS), "list-heavy": F.regexp_count(t, F.lit(",")) >= LIST_COMMAS, "troubleshoot": _holds(low, TROUBLE),
        "mod-support": t.rlike("(?i)" + X.ascii_bounds(r"\bmod(s|ok|ded|ding)?\b")), "multi-turn": _holds(low, TURNS),
    }
    return F.array_compact(F.array(*[F.when(c, n) for n, c in told.items()]))


def high_risk(text: str | Column, intent: str | Column) -> Column:
    return F.coalesce(F.trim(_c(intent)).isin(RISKY_INTENTS), F.lit(False)) | _holds(F.lower(F.coalesce(_c(text), F.lit(""))), RISKY)


def knowledge_mode(n_facts: Column, has_context: Column, tier: Column, risky: Column) -> Column:
    """UNKNOWN for the lowest tier and for questions of risk; else VERIFIED with facts, PARTIAL with a context alone."""
    return F.when((tier == "C") | risky, "UNKNOWN").when(n_facts > 0, "VERIFIED").when(has_context, "PARTIAL").otherwise("UNKNOWN")


def too_generic(answer: Column, context: Column, level: Column) -> Column:
    """Whether an answer neither names its context nor is as long as its level asks; level is held in 1 to 5, 3 if null."""
    body = F.trim(F.coalesce(answer, F.lit("")))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in LEAST_CHARS.items() for x in kv]), F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(level, F.lit(3)))).cast("int"))
    named = F.contains(F.lower(body), F.lower(context))
    return F.coalesce((F.coalesce(context, F.lit("")) != "") & (body != "") & ~named & (F.length(body) < least), F.lit(False))


def with_notice(answer: Column, mode: Column, lang: Column) -> Column:
    """The answer, and the notice of its language where it is not verified; an empty answer stays empty."""
    body = F.trim(F.coalesce(answer, F.lit("")))
    notice = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NOTICE.items() for x in kv]), F.coalesce(lang, F.lit("en"))), F.lit(NOTICE["en"]))
    return F.when((body == "") | (mode == "VERIFIED"), body).otherwise(F.concat(body, F.lit("\n\n"), notice))


def place_like(name: Column) -> Column:
    low = F.lower(name)
    out = _holds(low, PLACES)
    for e in PLACE_ENDINGS:
        out = out | low.endswith(e)
    return F.coalesce(out, F.lit(False))


def redaction_kind(name: Column, around: Column) -> Column:
    """What a name is of, by what stands around it: a character before an item, a skill and a place; else generic."""
    low = F.lower(F.coalesce(around, F.lit("")))
    return F.when(_holds(low, ["hero", "character", "named"]), "character").when(_holds(low, ["sword", "item", "weapon"]), "item").when(_holds(low, ["skill", "spell", "ability"]), "skill").when(place_like(name), "location").otherwise("generic")


def priority_label(priority: Column) -> Column:
    """3 is P1, 2 is P2, 1 is P3; labels stay; else null."""
    p = F.upper(F.trim(priority.cast("string")))
    return F.when(p.isin("3", "P1"), "P1").when(p.isin("2", "P2"), "P2").when(p.isin("1", "P3"), "P3")


def priority_weight(priority: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.coalesce(priority_label(priority), F.lit("-"))), F.lit(0.0))


def fact_score(keywords: Column, tags: Column, fact_tokens: Column, question: Column, tokens: Column, intent: Column, priority: Column) -> Column:
    """How much a fact has to do with a question.

    Two for each keyword or tag that the question has: phrases as they stand, words as tokens or, from four letters on,
    as the beginning of one another; without such one for each of the fact's tokens, four at most; one for a tag
    that is the intent; and the priority's weight where anything counts.
    """
    none = F.array().cast("array<string>")
    keys = F.filter(F.transform(F.concat(F.coalesce(keywords, none), F.coalesce(tags, none)), lambda k: X.text_key(k)), lambda k: k != "")
    begins = lambda w: F.exists(tokens, lambda t: t.startswith(w) | w.startswith(t))
    hit = F.filter(keys, lambda k: F.when(F.contains(k, F.lit(" ")), F.contains(question, k)).otherwise(F.array_contains(tokens, k) | ((F.length(k) >= 4) & begins(k))))
    by_words = F.size(F.filter(fact_tokens, lambda w: F.array_contains(tokens, w) | ((F.length(w) >= 4) & begins(w))))
    points = F.when(F.size(hit) > 0, 2 * F.size(hit)).otherwise(F.least(F.lit(4), by_words))
    points = points + F.when(F.coalesce(F.array_contains(F.coalesce(tags, none), intent), F.lit(False)), 1).otherwise(0)
    return F.when(points > 0, points + priority_weight(priority)).otherwise(F.lit(0.0))


def listed_names(text: Column, marker: str, most: int = 12) -> Column:
    """Quoted names, and those listed after "marker:" by commas and semicolons, in order, each once."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]{2,60})"'), F.lit(1))
    listed = F.split(F.regexp_extract(text, rf"(?i){marker}\s*:\s*([^\n.]*)", 1), r"\s*[,;]\s*")
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(quoted, listed), lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def facts_prompt(facts: Column, header: str = "Facts:") -> Column:
    """A header and a line for each fact; nothing without facts."""
    return F.when(F.size(facts) > 0, F.concat(F.lit(header + "\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"))).otherwise("")


def name_guard(allowed: Column, forbidden: Column) -> Column:
    """What names may and may not be used, by which of the two lists are there; forbidden names are not allowed."""
    ok = F.array_except(allowed, forbidden)
    a, b = F.array_join(ok, ", "), F.array_join(forbidden, ", ")
    return F.concat_ws(" ", F.when(F.size(ok) > 0, F.concat(F.lit("Use only these names: "), a, F.lit("."))), F.when(F.size(forbidden) > 0, F.concat(F.lit("Never use: "), b, F.lit("."))))


def profile_prompt(systems: Column) -> Column:
    """The systems of a map of switches that are on, sorted."""
    on = F.array_sort(F.map_keys(F.map_filter(systems, lambda k, v: v)))
    return F.when(F.size(on) > 0, F.concat(F.lit("Systems: "), F.array_join(on, ", "))).otherwise("")


def option_prompts(chosen: DataFrame, options: DataFrame, custom: str = "custom") -> DataFrame:
    """id and prompt: for each row of chosen (id, lang, options, custom) the prompts of its options (option, lang,
    prompt) in its order, English where its language has none and nothing where neither has, then its own words."""
    rows = chosen.select("id", "lang", F.posexplode_outer("options").alias("pos", "option"))
    own = options.select("option", F.col("lang").alias("lang"), F.col("prompt").alias("own"))
    english = options.where("lang = 'en'").select("option", F.col("prompt").alias("english"))
    found = rows.join(F.broadcast(own), ["option", "lang"], "left").join(F.broadcast(english), "option", "left")  # options are a list of settings
    lines = found.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.coalesce("own", "english").isNotNull(), F.struct("pos", F.coalesce("own", "english").alias("p"))))).alias("l"))
    out = lines.join(chosen.select("id", F.nullif(F.trim(custom), F.lit("")).alias("_custom")), "id")
    return out.select("id", F.concat_ws("\n", F.nullif(F.array_join(F.transform("l", lambda x: x["p"]), "\n"), F.lit("")), "_custom").alias("prompt"))


def assemble(segments: dict[str, Column], order: list[str]) -> Column:
    """Segments that are not empty, in order, with a blank line between them."""
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(segments[n], F.lit(""))) for n in order]), lambda s: s != ""), "\n\n")
