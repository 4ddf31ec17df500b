"""Which registered application a window is about: titles, processes, mappings and metadata as scored signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X

#: Rows of registries (a pattern that a text must match whatever its case) and of mappings (a part of a title).
REGISTRY_SCHEMA, MAPPINGS_SCHEMA = "order int, pattern string, name string", "order int, match string, name string"

# What each piece of evidence counts, and the least that tells an application.
SCORES = {"metadata": 7, "mapping": 6, "process": 5, "title": 4, "class": 2}
THRESHOLD = 6
# Parts of process names and window classes of browsers; own windows that are never looked at.
BROWSERS = ["chrome", "msedge", "firefox", "opera", "brave", "vivaldi", "arc"]
BROWSER_CLASSES = ["Chrome_WidgetWin", "MozillaWindowClass", "ApplicationFrameWindow", r"Windows\.UI\.Core\.CoreWindow"]
LAUNCHERS = ["steam", "epic games", "gog", "gog galaxy", "ubisoft connect", r"battle\.net", "battlenet", "ea app", "origin", "xbox", "microsoft store"]
NOISE = ["beta", "early access", "demo", "playtest", "launcher", "update", "patch", "build", "directx", r"dx\d+"]

SEPARATORS = [" - ", r" \| ", " — "]

_LAUNCHER = "(" + "|".join([*LAUNCHERS, "launcher"]) + ")"
_NOISE = "(" + "|".join(NOISE) + ")"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tidy_title(x: str | Column) -> Column:
    """A window title without marks, notes in brackets, versions and the launcher's name at its end.

    A note in round brackets goes where it ends in a word of NOISE, one in square brackets also where it ends in a
    launcher's name; "version 2" and "v1.2" go; so does what follows the last " - ", " | " or " — " if it ends in a
    launcher's name.  Null stays null.
    """
    out = F.regexp_replace(_c(x), "[™®]", "")
    out = F.regexp_replace(out, rf"(?i)\s*\([^)]*{_NOISE}\s*\)\s*", " ")
    out = F.regexp_replace(out, rf"(?i)\s*\[[^\]]*({_NOISE}|{_LAUNCHER})\s*\]\s*", " ")
    out = F.regexp_replace(out, X.ascii_bounds(r"(?i)\b(v|ver|version)\s*\d+(\.\d+){0,3}\b"), " ")
    for mark in SEPARATORS:
        out = F.regexp_replace(out, rf"(?i)^(.+){mark}.*{_LAUNCHER}\s*$", "$1")
    out = F.regexp_replace(out, rf"(?i)\s*[-–—]\s*({'|'.join(LAUNCHERS)})\s*$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def match_key(x: str | Column) -> Column:
    """Letters and digits of any script in lower case, in words with single spaces."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", " "))


def ignored(title: str | Column, listed: list[str] = (), own: list[str] = ()) -> Column:
    """Whether a title is not looked at: missing, of an own window (patterns), or with a listed part whatever its case."""
    t = _c(title)
    out = t.isNull() | (t == "")
    for p in own:
        out = out | t.rlike(f"(?i){p}")
    for part in (x.strip() for x in listed):
        if part:
            out = out | F.contains(F.lower(t), F.lit(part.lower()))
    return F.coalesce(out, F.lit(True))


def is_browser(name: str | Column, path: str | Column) -> Column:
    return F.concat_ws(" ", _c(name), _c(path)).rlike("(?i)" + "|".join(BROWSERS))


def is_browser_class(name: str | Column) -> Column:
    return F.coalesce(_c(name).rlike("(?i)" + "|".join(BROWSER_CLASSES)), F.lit(False))


def process_name(name: str | Column, path: str | Column) -> Column:
    """The base name of a process without its ending and with blanks for _ and -, by its path, else its name."""
    base = F.regexp_replace(F.regexp_extract(_c(path), r"([^\\/]+)[\\/]*$", 1), r"(?<=.)\.[^.]*$", "")
    found = F.when(F.coalesce(_c(path), F.lit("")) != "", base).otherwise(_c(name))
    return F.nullif(F.trim(F.regexp_replace(found, "[_-]+", " ")), F.lit(""))


def first_match(rows: DataFrame, text: str, registry: DataFrame, name: str = "name") -> DataFrame:
    """rows with the name of the first registry row, by order, whose pattern the text matches; null without one.

    Distinct texts are matched, each once, against the registry, which goes to all tasks as one array: a registry is
    a list of patterns, a few hundred rows.  Ties of order go to the pattern that sorts first.
    """
    listed = registry.agg(F.array_sort(F.collect_list(F.struct("order", "pattern", "name"))).alias("_registry"))
    texts = rows.select(F.col(text).alias("_text")).where(F.col(text).isNotNull()).distinct().crossJoin(F.broadcast(listed))  # one row
    hit = F.filter("_registry", lambda r: F.regexp_like("_text", F.concat(F.lit("(?i)"), r["pattern"])))
    texts = texts.select("_text", F.get(hit, F.lit(0))["name"].alias(name))
    return rows.drop(name).join(texts, F.col(text) == F.col("_text"), "left").drop("_text")


def mapped(rows: DataFrame, title: str, mappings: DataFrame, name: str = "mapped") -> DataFrame:
    """rows with the name of the first mapping (order, match, name), by order, whose match stands in the title; both
    are folded by match_key.  The list of mappings, two hundred at most, goes to all tasks as one array."""
    listed = mappings.withColumn("match", match_key("match")).where("match <> '' AND trim(name) <> ''").agg(F.array_sort(F.collect_list(F.struct("order", "match", F.trim("name").alias("name")))).alias("_mappings"))
    key = F.concat(F.lit(""), match_key(title))
    hit = F.filter("_mappings", lambda m: F.contains(key, m["match"]) & (key != ""))
    return rows.drop(name).crossJoin(F.broadcast(listed)).withColumn(name, F.get(hit, F.lit(0))["name"]).drop("_mappings")  # one row


def title_name(rows: DataFrame, title: str, registry: DataFrame, listed: list[str] = (), own: list[str] = (), name: str = "title_name") -> DataFrame:
    """rows with the application that a title tells.

    An ignored title tells none.  The tidied title is matched with the registry, then the title itself; without a
    match the tidied title stands for itself where tidying changed it and more than three characters are left, and
    else a title with a launcher's name, without it.
    """
    t = F.col(title)
    tidy = F.coalesce(F.nullif(tidy_title(t), F.lit("")), t)
    rows = rows.withColumns({"_tidy": F.when(~ignored(t, listed, own), tidy), "_whole": F.when(~ignored(t, listed, own), t)})
    rows = first_match(first_match(rows, "_tidy", registry, "_by_tidy"), "_whole", registry, "_by_title")
    bare = F.trim(F.regexp_replace(F.regexp_replace("_whole", r"(?i)\s*-\s*Steam$", ""), r"(?i)\s*-\s*Epic Games$", ""))
    itself = F.when((F.col("_tidy") != F.col("_whole")) & (F.length("_tidy") > 3), F.col("_tidy")).when(F.col("_whole").rlike("Steam|Epic Games") & (F.length(bare) > 3), bare)
    return rows.withColumn(name, F.coalesce("_by_tidy", "_by_title", itself)).drop("_tidy", "_whole", "_by_tidy", "_by_title")


def score_titles(windows: DataFrame, registry: DataFrame, mappings: DataFrame, listed: list[str] = (), own: list[str] = (), titles_alone: bool = False) -> DataFrame:
    """windows (title, process, path, class, metadata and others) with name, score, signals and reasons.

    Mapping, metadata, title, process and a class of no browser are signals, each with its points.  A window of a
    browser whose title alone tells something has no name, nor has one without a title that tells or with a single
    signal, unless a mapping speaks or titles_alone is set.  The name is the mapping's, else the metadata's, else the
    title's, and with titles_alone the process's.  Null columns are no signals.
    """
    rows = windows.withColumn("_process", process_name("process", "path"))
    rows = title_name(rows, "title", registry, listed, own, "_title_name")
    rows = title_name(rows, "_process", registry, listed, own, "_process_name")
    rows = mapped(rows, "title", mappings, "_mapped")
    told = {"mapping": F.col("_mapped"), "metadata": F.nullif(F.col("metadata"), F.lit("")), "title": F.col("_title_name"), "process": F.col("_process_name"), "class": F.when((F.coalesce("class", F.lit("")) != "") & ~is_browser_class("class"), F.col("class"))}
    number = lambda weight: sum((F.when(v.isNotNull(), weight(k)).otherwise(0) for k, v in told.items()), F.lit(0))
    rows = rows.withColumns({"score": number(SCORES.get), "signals": number(lambda _: 1), "_tells": F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), k) for k, v in told.items()])), "+")})
    browser = is_browser("process", "path") | is_browser_class("class")
    blocked = F.col("_mapped").isNull() & browser & F.col("_title_name").isNotNull() & F.col("_process_name").isNull()
    weak = F.lit(not titles_alone) & F.col("_mapped").isNull() & (F.col("_title_name").isNull() | (F.col("signals") < 2))
    name = F.coalesce(told["mapping"], told["metadata"], told["title"], F.when(F.lit(titles_alone), told["process"]))
    stop = F.when(blocked, "browser-block").when(weak, "min-signal")
    rows = rows.withColumns({"name": F.when(stop.isNull(), name), "reasons": F.concat_ws("+", F.nullif(F.col("_tells"), F.lit("")), stop)})
    return rows.drop("_process", "_title_name", "_process_name", "_mapped", "_tells")


def detect(windows: DataFrame, registry: DataFrame, mappings: DataFrame, listed: list[str] = (), own: list[str] = (), fallback: bool = True) -> DataFrame:
    """One row for each snapshot of windows (snapshot_id, place, is_active and those of score_titles): name, title,
    score, source.

    The active window's name is taken if its score reaches THRESHOLD; else, with fallback, the best name of the other
    windows by their titles alone, the first on equal scores.  Windows of a snapshot are aggregated, never gathered;
    of several active ones the first counts; snapshots without a name have null; an empty table gives an empty result.
    """
    active = score_titles(windows.where("is_active"), registry, mappings, listed, own)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("process", "path", "class", "metadata")]
    others = score_titles(windows.where("NOT is_active").select("snapshot_id", "place", "title", *nothing), registry, mappings, listed, own, titles_alone=True)
    found = active.select("snapshot_id", "place", "title", "name", "score", F.lit("active").alias("source"))
    if fallback:
        found = found.unionByName(others.select("snapshot_id", "place", "title", "name", "score", F.lit("fallback").alias("source")))
    good = F.col("name").isNotNull() & (F.col("score") >= THRESHOLD)
    best = F.min(F.when(good, F.struct((F.col("source") != "active").alias("later"), (-F.col("score")).alias("worse"), "place", "name", "title", "source"))).alias("b")
    g = found.groupBy("snapshot_id").agg(best)
    return g.select("snapshot_id", F.col("b.name").alias("name"), F.col("b.title").alias("title"), (-F.col("b.worse")).alias("score"), F.col("b.source").alias("source"))


def meets(result: str | Column, expect: str | Column, one_of: str | Column, none: str | Column, any_: str | Column) -> Column:
    """Whether a result is as expected: none at all, one of several, the one, or any; names whatever their case."""
    r = F.lower(_c(result))
    return F.coalesce(F.when(F.coalesce(_c(none), F.lit(False)), r.isNull()).when(_c(one_of).isNotNull(), F.array_contains(F.transform(_c(one_of), lambda x: F.lower(x)), r)).when(_c(expect).isNotNull(), r == F.lower(_c(expect))).when(F.coalesce(_c(any_), F.lit(False)), r.isNotNull()), F.lit(False))
