"""Queries that tell applications from window titles; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import detection as D
from factloom.sources.tables import table

#: Registered applications, mappings and titles that are not looked at; parameters that suit the test tables.
REGISTRY = [(1, "the and", "Theand"), (2, "(^|[^A-Za-z0-9_])st([^A-Za-z0-9_]|$)", "St"), (3, "nicht", "Nicht"), (4, "heit", "Heitspiel"), (5, "menteie", "Mente"), (6, "therwh|tionsh", "Therwh")]
MAPPINGS = [(1, "to the", "Tothe"), (2, " Ist! ", "Istspiel"), (3, "", "Nothing"), (4, "la", "Lala"), (5, "in in", " ")]
IGNORED, OWN = ["In a", ""], ["^Own ?Window"]
_HOST = "^https?://([^/?#:]+)"


def _registry(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(REGISTRY, D.REGISTRY_SCHEMA), spark.createDataFrame(MAPPINGS, D.MAPPINGS_SCHEMA)


def windows(spark, sf_dir) -> DataFrame:
    """Pages as windows: five a snapshot, with titles that end as those of launchers do, and processes named as hosts."""
    p = table(spark, sf_dir, "pages").withColumn("plain", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    at = lambda m, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % m + 1).cast("int"))
    host = F.regexp_extract("url", _HOST, 1)
    return p.select(
        F.floor(F.col("page_id") / 5).cast("bigint").alias("snapshot_id"), F.col("page_id").alias("place"), (F.col("page_id") % 5 == 0).alias("is_active"), F.concat("plain", at(4, " - Steam", " (Beta)", " [GOG Launcher]", " v1.2")).alias("title"),
        at(7, "chrome.exe", "a.exe", "b.exe", "c.exe", "d.exe", "e.exe", "f.exe").alias("process"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("C:\\\\Apps\\\\"), F.replace(host, F.lit("."), F.lit("_")), F.lit(".exe"))).alias("path"),
        F.nullif(at(3, "Chrome_WidgetWin_1", "UnityWndClass", ""), F.lit("")).alias("class"), F.when(F.col("page_id") % 11 == 0, F.lit("Known")).alias("metadata"),
    )


def title_matches(spark, sf_dir):
    """Tidied titles and the application that each tells."""
    w = windows(spark, sf_dir).select("place", "title")
    return D.title_name(w, "title", _registry(spark)[0], IGNORED, OWN, "name").select("place", D.tidy_title("title").alias("tidy"), "name")


def contains_map(spark, sf_dir):
    """Titles by the first mapping that they hold."""
    w = D.mapped(windows(spark, sf_dir).select("place", "title"), "title", _registry(spark)[1], "name")
    return w.select("place", D.match_key("title").alias("key"), "name")


def window_scores(spark, sf_dir):
    """Signals of each window, their score and the name they give."""
    return D.score_titles(windows(spark, sf_dir), *_registry(spark), IGNORED, OWN).select("place", "name", F.col("score").cast("bigint").alias("score"), F.col("signals").cast("bigint").alias("signals"), "reasons")


def detected_windows(spark, sf_dir):
    """The application of each snapshot, from its active window or the best of the others."""
    return D.detect(windows(spark, sf_dir), *_registry(spark), IGNORED, OWN).select("snapshot_id", "name", "title", F.col("score").cast("bigint").alias("score"), "source")


QUERIES = {f.__name__: f for f in (title_matches, contains_map, window_scores, detected_windows)}


def _tidy_sql(x: str) -> str:
    launcher, noise = D._LAUNCHER, D._NOISE
    out = f"regexp_replace({x}, '[™®]', '', 'g')"
    for pattern, by in ((rf"(?i)\s*\([^)]*{noise}\s*\)\s*", " "), (rf"(?i)\s*\[[^\]]*({noise}|{launcher})\s*\]\s*", " "), (r"(?i)\b(v|ver|version)\s*\d+(\.\d+){0,3}\b", " "), *((rf"(?i)^(.+){m}.*{launcher}\s*$", r"\1") for m in D.SEPARATORS), (rf"(?i)\s*[-–—]\s*({'|'.join(D.LAUNCHERS)})\s*$", ""), (r"\s+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def _name_sql(whole: str, tidy: str) -> str:
    """The application by a tidied title, by the title, or the title itself."""
    by = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{n}'" for _, p, n in REGISTRY) + " END"
    bare = f"trim(regexp_replace(regexp_replace({whole}, '(?i)\\s*-\\s*Steam$', ''), '(?i)\\s*-\\s*Epic Games$', ''))"
    return f"coalesce({by(tidy)}, {by(whole)}, CASE WHEN {tidy} <> {whole} AND length({tidy}) > 3 THEN {tidy} WHEN regexp_matches({whole}, 'Steam|Epic Games') AND length({bare}) > 3 THEN {bare} END)"


def _seen_sql(x: str) -> str:
    listed = " OR ".join(f"contains(lower({x}), '{p.strip().lower()}')" for p in IGNORED if p.strip())
    return f"CASE WHEN {x} <> '' AND NOT regexp_matches({x}, '(?i){OWN[0]}') AND NOT ({listed}) THEN {x} END"


_KEY = "trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_WINDOWS = f"""WITH p AS (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS plain, regexp_extract(url, '{_HOST}', 1) AS host FROM pages),
  w AS (SELECT host, page_id // 5 AS snapshot_id, page_id AS place, page_id % 5 = 0 AS is_active, plain || [' - Steam', ' (Beta)', ' [GOG Launcher]', ' v1.2'][page_id % 4 + 1] AS title, ['chrome.exe', 'a.exe', 'b.exe', 'c.exe', 'd.exe', 'e.exe', 'f.exe'][page_id % 7 + 1] AS process,
    CASE WHEN page_id % 2 = 0 THEN 'C:\\Apps\\' || replace(host, '.', '_') || '.exe' END AS path, nullif(['Chrome_WidgetWin_1', 'UnityWndClass', ''][page_id % 3 + 1], '') AS class, CASE WHEN page_id % 11 = 0 THEN 'Known' END AS metadata FROM p),
  t AS (SELECT *, {_tidy_sql("title")} AS tidy, {_KEY} AS key, CASE WHEN path IS NOT NULL THEN replace(host, '.', '_') ELSE process END AS proc FROM w),
  u AS (SELECT *, {_seen_sql("title")} AS seen, {_seen_sql("trim(regexp_replace(proc, '[_-]+', ' ', 'g'))")} AS seen_process FROM t),
  v AS (SELECT *, CASE WHEN seen IS NOT NULL THEN coalesce(nullif(tidy, ''), seen) END AS seen_tidy, CASE WHEN seen_process IS NOT NULL THEN coalesce(nullif({_tidy_sql("seen_process")}, ''), seen_process) END AS tidy_process FROM u),
  n AS (SELECT *, {_name_sql("seen", "seen_tidy")} AS title_name, {_name_sql("seen_process", "tidy_process")} AS process_name, CASE {" ".join(f"WHEN contains(key, '{m.strip(' !').lower()}') THEN '{n.strip()}'" for _, m, n in MAPPINGS if m.strip(" !") and n.strip())} END AS mapped FROM v)"""


def _scored_sql(rows: str, alone: bool) -> str:
    """Score, signals, reasons and name; with titles alone there is neither process, class nor metadata."""
    own = {"mapping": "mapped", "metadata": "NULL" if alone else "metadata", "title": "title_name", "process": "NULL" if alone else "process_name", "class": "NULL" if alone else "CASE WHEN class <> '' AND NOT regexp_matches(class, '(?i)Chrome_WidgetWin|MozillaWindowClass|ApplicationFrameWindow|Windows.UI.Core.CoreWindow') THEN class END"}
    score = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN {D.SCORES[k]} ELSE 0 END" for k, v in own.items())
    signals = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN 1 ELSE 0 END" for v in own.values())
    browser = "false" if alone else "(regexp_matches(concat_ws(' ', process, path), '(?i)" + "|".join(D.BROWSERS) + "') OR coalesce(regexp_matches(class, '(?i)Chrome_WidgetWin|MozillaWindowClass'), false))"
    stop = f"CASE WHEN mapped IS NULL AND {browser} AND title_name IS NOT NULL AND {own['process']} IS NULL THEN 'browser-block' " + ("" if alone else f"WHEN mapped IS NULL AND (title_name IS NULL OR {signals} < 2) THEN 'min-signal' ") + "END"
    tells = "concat_ws('+', " + ", ".join(f"CASE WHEN {v} IS NOT NULL THEN '{k}' END" for k, v in own.items()) + f", {stop})"
    return f"SELECT *, CAST({score} AS BIGINT) AS score, CAST({signals} AS BIGINT) AS signals, {tells} AS reasons, CASE WHEN ({stop}) IS NULL THEN coalesce(mapped, {own['metadata']}, title_name) END AS name FROM {rows}"


SQL = {
    "title_matches": _WINDOWS + " SELECT place, tidy, title_name AS name FROM n",
    "contains_map": _WINDOWS + " SELECT place, key, mapped AS name FROM n",
    "window_scores": _WINDOWS + ", s AS (" + _scored_sql("n", False) + ") SELECT place, name, score, signals, reasons FROM s",
    "detected_windows": _WINDOWS + ", a AS (" + _scored_sql("n WHERE is_active", False) + "), o AS (" + _scored_sql("n WHERE NOT is_active", True) + "), f AS (SELECT snapshot_id, place, title, name, score, 'active' AS source FROM a UNION ALL SELECT snapshot_id, place, title, name, score, 'fallback' FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY source <> 'active', -score, place) AS rn FROM f WHERE name IS NOT NULL AND score >= 6) SELECT i.snapshot_id, r.name, r.title, r.score, r.source FROM (SELECT DISTINCT snapshot_id FROM f) i LEFT JOIN r ON i.snapshot_id = r.snapshot_id AND rn = 1",
}
