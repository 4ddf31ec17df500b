"""Sources and sinks: tables, page bodies, candidate facts, manifests, stable JSON, JSON lines."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that executors and driver share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


#: Whether Spark deletes what a query has shuffled at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder that spark.checkpoint.dir names, or where that is unset in the
    warehouse, read back: a round of an iteration then depends on that table and on nothing before it.  What was
    shuffled for the table is deleted once it is written; else it would stay until the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete what `written` wrote for these; nothing that is still to be computed may depend on them."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Tables of fewer files than cores are dealt over all cores when read, or over as many tasks as they have of this: such
#: a file may have few row groups, whatever its size, and a row group is read by one task.
SMALL_BYTES = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, and no more than about SMALL_BYTES a task, where it is in few files; other tables stay as they
    are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // SMALL_BYTES)))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their sentences in order."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return docs.select("doc_id", "lang", "source", F.split("text", "[.!?]+\\s+").alias("p"))


def facts(spark: SparkSession, sf_dir: str, context: bool = False) -> DataFrame:
    """Candidate facts: the sentences of documents in their order; of a null text one null fact.  It stands for
    extraction by a remote model.  context adds what stands within 140 characters around a fact."""
    parts = pieces(spark, sf_dir)
    if not context:
        rows = parts.select("doc_id", "lang", "source", F.posexplode_outer("p").alias("pos", "raw"))
        return rows.withColumn("pos", F.coalesce("pos", F.lit(0))).withColumn("fact", X.collapse("raw"))
    around = F.transform("p", lambda x, i: F.struct(x.alias("raw"), F.concat_ws(" ", F.right(F.get("p", i - 1), F.lit(140)), x, F.left(F.get("p", i + 1), F.lit(140))).alias("context")))
    rows = parts.select("doc_id", "lang", "source", F.posexplode_outer(around).alias("pos", "x"))
    return rows.select("doc_id", "lang", "source", F.coalesce("pos", F.lit(0)).alias("pos"), F.col("x.raw").alias("raw"), F.col("x.context").alias("context")).withColumn("fact", X.collapse("raw"))


def article_body(html: str | Column) -> Column:
    """The longest of the usual containers of a page without its navigation, else the page."""
    h = F.col(html) if isinstance(html, str) else html
    found = F.array(*[F.regexp_extract(h, f"(?is)<{t}[^>]*>(.*)</{t}>", 1) for t in ("article", "main", "body")])
    best = F.aggregate(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    inner = F.coalesce(F.when(found[0] != "", found[0]), F.when(found[1] != "", found[1]), best)
    return F.regexp_replace(F.when(inner == "", h).otherwise(inner), "(?is)<(nav|header|footer|aside|script|style)[^>]*>.*?</\\1>", "")


def absolute_url(link: str | Column, base: str | Column) -> Column:
    """A link as seen from the address of its page: whole ones as they are, those from the host or scheme on, those
    beside the page, and ../ steps up from it."""
    u, b = (F.col(x) if isinstance(x, str) else x for x in (link, base))
    scheme, host = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(b, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    path = F.regexp_replace(F.concat(folder, u), "/\\./", "/")
    for _ in range(4):
        path = F.regexp_replace(path, "/[^/]+/\\.\\./", "/")
    path = F.regexp_replace(path, "^(/\\.\\.)+/", "/")
    return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(scheme, u)).when(u.startswith("/"), F.concat(host, u)).when(u.startswith("?"), F.concat(F.regexp_replace(b, "[?#].*$", ""), u)).otherwise(F.concat(host, path))


def markup_text(html: str | Column) -> Column:
    """Headings as marks, blocks as lines, tags gone, entities decoded."""
    out = F.col(html) if isinstance(html, str) else html
    for n in range(1, 7):
        out = F.regexp_replace(out, f"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    out = F.regexp_replace(out, "(?is)<(script|style)[^>]*>.*?</\\1>", "")
    out = F.regexp_replace(out, "(?i)<(br|/?p|/?li|/?div|/?tr|/?ul|/?ol)[^>]*>", "\n")
    out = X.decode_entities(F.regexp_replace(out, "<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "(?i)\\[(edit|hide|show)\\]", ""), "\n\\s*\n+", "\n\n"), "^\\s+|\\s+$", "")


def within_size(pages: DataFrame, cap: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """Pages up to the byte cap, and those beyond it."""
    size = F.octet_length("html")
    return pages.where(size <= cap), pages.where(size > cap).withColumn("error", F.lit("source-too-large"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Application manifests of key-value text: app_id, title, folder."""
    raw = spark.read.text(path, wholetext=True)
    at = lambda key: F.regexp_extract("value", f'(?i)"{key}"\\s+"([^"]*)"', 1)
    return raw.select(F.lit("steam").alias("source"), at("appid").alias("app_id"), at("name").alias("title"), at("installdir").alias("folder"))


def salvage_json(x: str | Column, schema: str) -> Column:
    """Whatever stands between the first opening and the last closing bracket, parsed."""
    c = F.col(x) if isinstance(x, str) else x
    return F.from_json(F.regexp_extract(c, "(?s)([\\[{].*[\\]}])", 1), schema)


def stable_json(m: str) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def keep_recent(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)
