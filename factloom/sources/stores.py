"""Job lists, stores with fallbacks, manifests, folders of pages, packages, logs and state as tables and files."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from factloom.sources.tables import read_manifests

JOBS = "game string, url string, `in` string, sourceType string, tier string, out string"
STORED_FACT = "id string, text string, keywords array<string>, tags array<string>, priority int, system string, gameStage string, sourceType string, confidence double"
MANIFEST = "source string, app_id string, title string, folder string"
#: How far a source of facts is to be relied on.
RELIABILITY = {"official": 3, "trusted": 2, "community": 1, "user": 0}


def read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and text of files, each as one row."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def one_input(url: str | None, path: str | None, text: str | None) -> str:
    """Which of the three inputs is given; exactly one must be."""
    given = [n for n, v in (("url", url), ("in", path), ("stdin", text)) if v]
    if len(given) != 1:
        raise ValueError(f"exactly one of url, in and stdin must be given, not {len(given)}")
    return given[0]


def read_jobs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON array of jobs: those with a game and one input, and the others with what is wrong with them."""
    jobs = spark.read.schema(JOBS).json(path, multiLine=True).withColumn("place", F.monotonically_increasing_id())
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fault = F.when(empty("game"), "game-missing").when(empty("url") & empty("in"), "input-missing").when(~empty("url") & ~empty("in"), "two-inputs")
    jobs = jobs.withColumn("fault", fault)
    return jobs.where("fault IS NULL").drop("fault"), jobs.where("fault IS NOT NULL")


def read_first(spark: SparkSession, folders: Iterable[str], name: str, schema: str, default: str = "_default") -> DataFrame:
    """The store of a name from the first folder that has one, else the default's from the first that has that, else
    no rows.  A store is a folder or file of JSON called by its name."""
    for wanted in (name, default):
        for folder in folders:
            try:
                found = spark.read.schema(schema).json(f"{folder.rstrip('/')}/{wanted}", multiLine=True)
                if found.inputFiles():
                    return found
            except AnalysisException:
                continue
    return spark.createDataFrame([], schema)


def write_keyed(df: DataFrame, path: str, key: str = "game") -> None:
    """Replace the stores of those keys that df has, and leave all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_keyed(spark: SparkSession, path: str, key: str, value: str, schema: str) -> DataFrame:
    """The store of one key, which prunes to its folder; no rows where there is none."""
    try:
        return spark.read.parquet(path).where(F.col(key) == value)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def add_facts(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored and added facts with their reliability by source; an added id that is stored already is left out."""
    new = added.join(stored.select("id").where("id IS NOT NULL").distinct(), "id", "left_anti")
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RELIABILITY.items() for x in kv]), F.lower(F.trim(F.coalesce("sourceType", F.lit("user"))))), F.lit(0))
    return stored.unionByName(new.select(*stored.columns)).withColumn("reliability", rank)


def library_folders(text: str | Column) -> Column:
    """Folders of a launcher's library list: "path" entries, or where there are none numbered ones; \\\\ as \\."""
    c = F.col(text) if isinstance(text, str) else text
    modern = F.regexp_extract_all(c, F.lit(r'(?i)"path"\s+"([^"]+)"'), F.lit(1))
    legacy = F.regexp_extract_all(c, F.lit(r'"\d+"\s+"([^"]+)"'), F.lit(1))
    return F.array_distinct(F.transform(F.when(F.size(modern) > 0, modern).otherwise(legacy), lambda p: F.replace(p, F.lit("\\\\"), F.lit("\\"))))


def read_item_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests that are JSON objects, with alternates for each name."""
    names = {"app_id": ["AppName", "CatalogItemId", "appId"], "title": ["DisplayName", "AppTitle", "title"], "folder": ["InstallLocation", "installPath"]}
    raw = spark.read.schema(", ".join(f"{n} string" for v in names.values() for n in v)).json(path, multiLine=True)
    return raw.select(F.lit("epic").alias("source"), *[F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in v]).alias(k) for k, v in names.items()]).where("title IS NOT NULL AND folder IS NOT NULL")


def read_local_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of applications that a user entered."""
    raw = spark.read.schema("installPath string, title string, appId string").json(path, multiLine=True)
    return raw.select(F.lit("local").alias("source"), F.col("appId").alias("app_id"), F.trim("title").alias("title"), F.trim("installPath").alias("folder")).where("title <> '' AND folder <> ''")


def read_all_manifests(spark: SparkSession, local: str | None, steam: str | None, epic: str | None) -> DataFrame:
    """Manifests of three kinds, local ones before steam's before epic's by src_rank; a missing path gives none."""
    parts = [read(spark, path) if path else spark.createDataFrame([], MANIFEST) for read, path in ((read_local_manifests, local), (read_manifests, steam), (read_item_manifests, epic))]
    out = parts[0].withColumn("src_rank", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("src_rank", F.lit(k)))
    return out


def folder_owner(rows: DataFrame, path: str, manifests: DataFrame) -> DataFrame:
    """rows with the title and source of the manifest in whose folder a path lies: the longest folder, then the lowest
    src_rank.  Each path is looked up under all the folders above it, so the lookup is an equal join."""
    key = lambda c: F.regexp_replace(F.lower(F.replace(c, F.lit("/"), F.lit("\\"))), r"\\+$", "")
    parts = F.split(key(F.col(path)), r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))
    up = rows.select(path).where(F.col(path).isNotNull()).distinct().select(path, F.explode(above).alias("_folder"))
    own = manifests.select(key(F.col("folder")).alias("_folder"), "title", "source", "src_rank").where("_folder <> ''")
    best = up.join(own, "_folder").groupBy(path).agg(F.max(F.struct(F.length("_folder").alias("n"), (-F.col("src_rank")).alias("r"), "title", "source")).alias("_m"))
    return rows.join(best, path, "left").withColumns({"title": F.col("_m.title"), "manifest_source": F.col("_m.source")}).drop("_m")


def read_fact_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of a folder of JSON pages, each tagged with its page and its place in it; packages are left out."""
    raw = spark.read.schema(f"facts array<struct<{STORED_FACT}>>").json(f"{folder.rstrip('/')}/*.json", multiLine=True)
    page = F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.json$", "")
    return raw.select(page.alias("page"), "facts").where("page NOT LIKE 'neighborhood-%' AND page <> 'package'").select("page", F.posexplode("facts").alias("index", "fact")).select("page", "index", "fact.*")


def list_files(spark: SparkSession, folder: str, ignored: Iterable[str] = ("node_modules", ".git")) -> DataFrame:
    """path, size and time of all files below a folder, those in ignored folders left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), "modificationTime")
    for name in ignored:
        files = files.where(~F.contains("path", F.lit(f"/{name}/")))
    return files


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows as lines of JSON; rows that are there already stay as they are."""
    df.write.mode("append").json(path)


def write_result(df: DataFrame, path: str, meta: dict | None = None, dry_run: bool = False) -> DataFrame:
    """Facts as JSON beside a small file of what is known of the run; a dry run only gives the lines."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    if not dry_run:
        lines.write.mode("overwrite").text(f"{path.rstrip('/')}/facts")
        df.sparkSession.createDataFrame([(json.dumps(meta or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/meta")
    return lines


def write_package(parts: dict[str, DataFrame], path: str, by: str | None = None) -> None:
    """Each part of a package as JSON in a folder of its name, split by a column where it has that."""
    for name, df in parts.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by and by in df.columns else writer).json(f"{path.rstrip('/')}/{name}")


def write_by_decision(facts: DataFrame, decisions: DataFrame, path: str) -> None:
    """Facts in folders of approved, rejected and pending ones, by the last decision on each."""
    last = decisions.groupBy("id").agg(F.max_by("decision", "at").alias("decision"))
    out = facts.drop("decision").join(last, "id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
    out.write.mode("overwrite").partitionBy("decision").json(path)


def save_state(spark: SparkSession, path: str, seed: str, state: dict) -> None:
    """The state of a crawl under its seed, one small row a save."""
    row = spark.createDataFrame([(seed, json.dumps(state, sort_keys=True))], "seed string, state string").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str, seed: str) -> dict:
    """The last saved state of a seed, or an empty one."""
    try:
        row = spark.read.parquet(path).where(F.col("seed") == seed).agg(F.max_by("state", "at").alias("state")).first()
    except AnalysisException:
        return {}
    return json.loads(row.state) if row and row.state else {}


def share_last(events: DataFrame, most: int = 20) -> DataFrame:
    """For each type of event the newest as JSON, and the newest `most` as a list."""
    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    top = events.select("event_type", "ts", "event_id", "value", F.row_number().over(w).alias("rn")).where(F.col("rn") <= most)
    entry = F.struct("rn", F.struct("event_id", "value").alias("e"))
    listed = top.groupBy("event_type").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select("event_type", F.to_json(F.col("l")[0]["e"]).alias("last"), F.to_json(F.transform("l", lambda x: x["e"])).alias("snapshots"))


def merge_deep(base: dict, over: dict) -> dict:
    """over laid upon base: nested settings are merged, other values and lists that are not empty replace."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge_deep(out[k], v)
        elif not (v is None or v == []):
            out[k] = v
    return out


#: A policy where none is given.
POLICY = {"sourcePolicy": {"allowList": [], "blockList": [], "blockedPatterns": []}, "factLimits": {"textMaxLength": 240, "keywordsMax": 8, "keywordMaxLength": 24}, "priority": {"min": 1, "max": 3, "default": 2}, "hardFilters": {"lorePatterns": ["lore", "story"]}, "rejectPayloadFields": [], "dedupe": {"similarity": 0.93, "minTokenOverlap": 6, "minTokens": 8, "action": "drop"}}


def read_policy(spark: SparkSession, path: str | None) -> dict:
    """A policy file laid upon POLICY, its source lists in lower case; POLICY itself where there is none or a broken one."""
    text = None
    if path:
        try:
            row = spark.read.text(path, wholetext=True).first()
            text = row.value if row else None
        except AnalysisException:
            text = None
    try:
        given = json.loads(text) if text else {}
    except json.JSONDecodeError:
        given = {}
    out = merge_deep(POLICY, given if isinstance(given, dict) else {})
    out["sourcePolicy"] = {k: [str(x).strip().lower() for x in v] for k, v in out["sourcePolicy"].items()}
    return out

