"""Queries over pinned entries, routed events and totals of loads; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import context
from factloom.sources.tables import table

#: Lists that events go to by their names; the names of clicks of small value stand apart.
LISTS = {"view": "requests", "purchase": "responses", "error": "violations", "click": "previews", "click-small": "simulated", "signup": "strategies"}
SMALL = 20
#: What is searched in pinned entries.
NEEDLE = "1"


def pinned_split(spark, sf_dir):
    """Customers whose finished orders pin them, and the others, by number."""
    c, pins = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    both = c.join(pins, "c_custkey", "left_semi").withColumn("pinned", F.lit(True)).unionByName(c.join(pins, "c_custkey", "left_anti").withColumn("pinned", F.lit(False)))
    return both.groupBy("c_nationkey", "pinned").agg(F.count(F.lit(1)).alias("n"))


def pinned_windows(spark, sf_dir):
    """Pinned customers that a search finds, with their newest urgent order."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit(NEEDLE))).select("c_custkey").join(o, "c_custkey")


def event_routes(spark, sf_dir):
    """Events by the list that their type goes to, the newest of each list."""
    name = F.when((F.col("event_type") == "click") & (F.col("value") < SMALL), "click-small").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), name.alias("name"))
    return context.newest_by_list(e, "name", ["ts", "event_id"], LISTS).select(F.col("list").alias("route"), "event_id", F.col("place").cast("bigint").alias("rn"))


def load_totals(spark, sf_dir):
    """Requests and answers of conversations: how many, their characters in all and on average, and turns without an answer."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered"), F.sum(F.length("text")).alias("chars"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("asked").alias("asked"), F.sum("answered").alias("answered"), F.sum(F.greatest(F.lit(0), F.col("asked") - F.col("answered"))).alias("unanswered"), F.sum("chars").alias("chars"), (F.sum("chars") / F.count(F.lit(1))).alias("mean_chars"))


def largest_prompts(spark, sf_dir):
    """The eight largest conversations, and how far each is from the mean."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).cast("bigint").alias("chars"), F.count(F.lit(1)).alias("turns"))
    mean = g.agg(F.avg("chars").alias("mean"))
    return g.crossJoin(F.broadcast(mean)).orderBy(F.col("chars").desc(), "conv_id").limit(8).select("conv_id", "chars", "turns", (F.col("chars") / F.col("mean")).alias("times_mean"))  # one row


QUERIES = {f.__name__: f for f in (pinned_split, pinned_windows, event_routes, load_totals, largest_prompts)}

SQL = {
    "pinned_split": "SELECT c_nationkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS pinned, count(*) AS n FROM customer GROUP BY 1, 2",
    "pinned_windows": f"SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE contains(lower(c_name), '{NEEDLE}') AND o_orderpriority LIKE '1%' GROUP BY 1",
    "event_routes": "SELECT route, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT event_id, ts, CASE " + f"CASE WHEN event_type = 'click' AND value < {SMALL} THEN 'click-small' ELSE event_type END " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LISTS.items()) + f" END AS route FROM events) WHERE route IS NOT NULL) WHERE rn <= {context.KEPT}",
    "load_totals": "WITH g AS (SELECT conv_id, count_if(role = 'user') AS asked, count_if(role = 'assistant') AS answered, sum(length(text)) AS chars FROM conversations GROUP BY 1) SELECT count(*) AS n, CAST(sum(asked) AS BIGINT) AS asked, CAST(sum(answered) AS BIGINT) AS answered, CAST(sum(greatest(0, asked - answered)) AS BIGINT) AS unanswered, CAST(sum(chars) AS BIGINT) AS chars, sum(chars) / count(*) AS mean_chars FROM g",
    "largest_prompts": "WITH g AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS turns FROM conversations GROUP BY 1) SELECT conv_id, chars, turns, chars / (SELECT avg(chars) FROM g) AS times_mean FROM g ORDER BY chars DESC, conv_id LIMIT 8",
}
