"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, discard, hot_keys, materialise, spread_join

LEVELS = ("domain", "lang", "source")
DEFAULT_SEED = 17
#: Documents of a leaf and epoch are first put in this many ranges of their shuffle key.
RANGES = 4096


def domain_of(source: str | Column = "source", domains: int = 4) -> Column:
    """The default domain of a source: its trailing number modulo `domains`; sources without one are 'other'."""
    number = F.regexp_extract(F.col(source) if isinstance(source, str) else source, "([0-9]+)$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("decimal(38,0)") % domains).cast("int").cast("string")))


def token_count(text: str = "text") -> Column:
    """Tokens by which budgets are kept: a fourth of the text's code points, rounded up."""
    return F.ceil(F.char_length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long")


def plan_budgets(capacity: DataFrame, names: list[str], tokens: str, weights: Mapping[tuple, float], total: int) -> DataFrame:
    """Split `total` tokens over leaves, level by level from the root: names, _budget, and _barred where a weight of a
    leaf or of a node above it is 0 or less.

    capacity: a row for each leaf, with its `names` from root to leaf (not null) and the tokens that it can give.
    weights: of any prefix of a leaf's names among its siblings; 1 where none is stated; a barred leaf gets nothing.
    A node's budget goes to its children by weight; what one of them cannot take goes to
    its siblings by their weights, and only what all of them together cannot take goes up to the ancestors' other
    children.  Shares are whole tokens: the largest remainders are rounded up, in order of name where they are equal.

    Children are ordered by what they hold for each unit of weight.  Those that are filled come first, as each of
    them leaves more for the rest; so sums over that order tell which are filled.  The rows ordered in one task are
    those of one parent node, a few numbers each.  No leaves give no rows.
    """
    spark = capacity.sparkSession
    rows = capacity.select(*names, F.col(tokens).cast("long").alias("_holds"))
    for d in range(1, len(names) + 1):
        stated = [(*k, float(w)) for k, w in weights.items() if len(k) == d]
        by_weight = spark.createDataFrame(stated, ", ".join([*(f"`{c}` string" for c in names[:d]), f"_w{d} double"]))
        by_weight = F.broadcast(by_weight) if len(stated) <= BROADCAST_ROWS else by_weight
        rows = rows.join(by_weight, names[:d], "left").withColumn(f"_w{d}", F.greatest(F.coalesce(f"_w{d}", F.lit(1.0)), F.lit(0.0)))
    dead = sum((F.when(F.col(f"_w{d}") <= 0, 1).otherwise(0) for d in range(1, len(names) + 1)), F.lit(0))
    rows = materialise(rows.withColumns({"_barred": dead > 0, "_holds": F.when(dead > 0, 0).otherwise(F.coalesce("_holds", F.lit(0)))}), "leaves")
    amounts = rows.agg(F.least(F.lit(total), F.coalesce(F.sum("_holds"), F.lit(0))).cast("long").alias("_amount"))
    for d in range(1, len(names) + 1):
        parent, name, w = names[: d - 1], names[d - 1], F.col("_w")
        nodes = rows.groupBy(*names[:d]).agg(F.sum("_holds").alias("_holds"), F.first(f"_w{d}").alias("_w"))
        nodes = nodes.join(amounts, parent) if parent else nodes.crossJoin(F.broadcast(amounts))  # one row
        ratio = F.when(w > 0, F.col("_holds") / w).otherwise(0.0)
        along = Window.partitionBy(*parent).orderBy(ratio, name)
        nodes = nodes.withColumns({"_left": F.col("_amount") - F.coalesce(F.sum("_holds").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_weight": F.sum("_w").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
        nodes = nodes.withColumn("_full", F.when(F.col("_weight") > 0, F.col("_left") * w / F.col("_weight")).otherwise(0.0) >= F.col("_holds"))
        # those that are not filled share what is left at the first of them
        first = F.max(F.when(~F.col("_full"), F.struct("_left", "_weight"))).over(Window.partitionBy(*parent))
        nodes = nodes.withColumn("_first", first)
        nodes = nodes.withColumn("_asked", F.when(F.col("_full") | (F.col("_first._left") <= 0), 0.0).otherwise(F.col("_first._left") * w / F.col("_first._weight")))
        nodes = nodes.withColumn("_whole", F.floor("_asked").cast("long"))
        by_rest = Window.partitionBy(*parent).orderBy(F.col("_full"), (F.col("_whole") - F.col("_asked")), name)
        rest = F.greatest(F.col("_first._left"), F.lit(0)) - F.sum("_whole").over(Window.partitionBy(*parent))
        nodes = nodes.withColumn("_more", F.when(~F.col("_full") & (F.row_number().over(by_rest) <= rest), 1).otherwise(0))
        share = F.when(F.col("_full"), F.col("_holds")).otherwise(F.least(F.col("_whole") + F.col("_more"), F.col("_holds")))
        amounts = materialise(nodes.select(*names[:d], share.cast("long").alias("_amount")), "budgets")
    return rows.select(*names, "_barred").join(amounts.withColumnRenamed("_amount", "_budget"), names)


def shuffle_key(seed: int, epoch: str | Column = "_epoch") -> Column:
    """The place of a document in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string") if isinstance(epoch, str) else epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, weights: Mapping[tuple, float] | None = None, total_tokens: int | None = None, fraction: float = 0.5, max_epochs: int = 1, seed: int = DEFAULT_SEED, domain: Column | None = None) -> DataFrame:
    """Choose documents so that the tokens of the domain-language-source tree follow the target weights.

    weights: of nodes among their siblings, by tuple; see plan_budgets.  total_tokens: tokens to choose, or else
    `fraction` of those in docs.  A leaf with fewer tokens than its budget starts again, up to max_epochs times,
    each epoch in an order of its own; what it cannot give is budgeted elsewhere.  Of an epoch's order the longest
    prefix within the budget is taken: the first document that would exceed it ends the leaf.  A leaf with tokens
    but no budget gives no documents, nor does one of weight 0 or below such a node.

    Returns the columns of docs and mix_epoch, mix_tokens.  Null domain, language or source are leaves of the
    name ''; a null or empty text has no tokens and costs nothing; rows that share a doc_id share a place in the
    order and are taken together or not at all; a clash with mix_epoch or mix_tokens is settled for the new one;
    an empty table gives an empty result.  No documents are sorted as a whole: totals over ranges of the shuffle
    key find the one range of each leaf in which the budget ends, and only that range is ordered.
    """
    names = [c for c in docs.columns if c.lower() not in ("mix_epoch", "mix_tokens")]
    kept = docs.select(F.struct(*names).alias("_row"), "doc_id", *[F.coalesce(c, F.lit("")).alias(f"_{k}") for k, c in zip(LEVELS, (domain if domain is not None else domain_of(), F.col("lang"), F.col("source")), strict=True)], token_count().alias("_tokens"))
    leaf = [f"_{k}" for k in LEVELS]
    rows = kept.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))) if max_epochs > 1 else kept.withColumn("_epoch", F.lit(0))
    rows = rows.withColumn("_key", shuffle_key(seed)).withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    ranges = materialise(rows.groupBy(*leaf, "_epoch", "_range").agg(F.sum("_tokens").alias("_sum"), F.count(F.lit(1)).alias("_n")), "mix-ranges")
    leaves = materialise(ranges.groupBy(*leaf).agg(F.sum(F.when(F.col("_epoch") == 0, F.col("_sum")).otherwise(0)).alias("_once"), F.sum("_n").alias("_n")).withColumn("_can", F.col("_once") * max_epochs), "mix-leaves")
    tokens, n, count = leaves.agg(F.coalesce(F.sum("_once"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    plan = plan_budgets(leaves, leaf, "_can", weights or {}, int(tokens * fraction) if total_tokens is None else total_tokens)
    gives = ~F.col("_barred") & ((F.col("_budget") > 0) | (F.col("_once") == 0))
    plan = materialise(leaves.join(plan, leaf).select(*leaf, "_budget", gives.alias("_any"), "_n"), "mix-plan")
    along = Window.partitionBy(*leaf).orderBy("_epoch", "_range")
    small = count <= BROADCAST_ROWS
    cut = (
        ranges.withColumn("_through", F.sum("_sum").over(along)).join(F.broadcast(plan.drop("_n")) if small else plan.drop("_n"), leaf)
        .groupBy(*leaf)
        .agg(F.min(F.when(F.col("_through") > F.col("_budget"), F.struct("_epoch", "_range", (F.col("_budget") - F.col("_through") + F.col("_sum")).alias("_left")))).alias("_cut"), F.first("_any").alias("_any"))
    )
    cut = materialise(cut, "mix-cut")  # one row a leaf
    rows = rows.join(F.broadcast(cut), leaf) if small else spread_join(rows, cut, leaf, hot_keys(plan, leaf, "_n", n), "_key")
    rows = rows.where("_any")
    at, end = F.struct("_epoch", "_range"), F.struct(F.col("_cut._epoch").alias("_epoch"), F.col("_cut._range").alias("_range"))
    whole = rows.where(F.col("_cut").isNull() | (at < end))
    edge = rows.where(F.col("_cut").isNotNull() & (at == end))
    within = Window.partitionBy(*leaf, "_epoch", "_range").orderBy("_key")
    edge = edge.withColumn("_sum", F.sum("_tokens").over(within)).where(F.col("_sum") <= F.col("_cut._left"))
    discard(ranges, leaves, plan)
    last = [F.col("_epoch").cast("int").alias("mix_epoch"), F.col("_tokens").alias("mix_tokens")]
    out = whole.select("_row", *last).unionByName(edge.select("_row", *last))
    return out.select("_row.*", "mix_epoch", "mix_tokens")
