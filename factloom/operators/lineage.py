"""From candidate facts to final ones in one call, with the way of every single fact: filters, merge, shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.mechanics import for_spark
from factloom.sources.tables import written

_PRIORITY = "greatest(1, least(3, CASE WHEN inter >= 2 AND o <= 50 AND v >= 55 THEN 3 WHEN v >= 75 AND (inter >= 2 OR o <= 35) THEN 3 WHEN (inter >= 2 OR n_systems >= 2) AND o <= 50 THEN greatest(2, final_priority) WHEN o >= 75 THEN 1 WHEN o >= 60 THEN least(2, final_priority) ELSE final_priority END))"
# Novelty and obviousness after the penalty of two hundredths a repetition too many, and the priority anew
# where there is one; how many facts of a shape are not too many; from which share of top priorities on a smaller stays.
SHAPING = {
    "v": "greatest(0, coalesce(novelty, 50) - 2 * extra)", "o": "least(100, coalesce(obviousness, 50) + 2 * extra)",
    "priority": f"CASE WHEN extra = 0 THEN final_priority WHEN t_resource AND NOT guard AND inter < 2 AND n_systems < 2 THEN least(2, {_PRIORITY}) ELSE {_PRIORITY} END",
}
REPEATED, TOP_SHARE, TOP_STAYS = 3, 0.2, 0.15
#: Sides of no more rows may be broadcast.
SMALL = 100_000
#: Documents that one task puts in order where a source's last top priorities are dealt out.
_DOCS_BITS = 12
READ = ["source", "fact", "drop_reason", "layer", "novelty", "obviousness", "final_priority", "score_a", "inter", "shape", "n_systems", "t_resource", "guard"]


def _beside(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a written side, broadcast if it is small."""
    side = written(side, "side")
    return rows.join(F.broadcast(side) if side.count() <= SMALL else side, on, "left")


def shaped(final: DataFrame) -> DataFrame:
    """Facts with extra, v, o, priority after the penalty for repeated shapes, and capped: whether the cap takes the top
    priority from them.

    final: doc_id, pos and READ.  Counts by source and by what decides tell where the cap falls; only facts that are
    alike in all of it, of a few thousand documents, are put in order.
    """
    f = final.withColumn("_s", F.coalesce("source", F.lit("")))
    repeated = f.where("shape <> ''").groupBy("_s", "shape").agg((F.count(F.lit(1)) - REPEATED).alias("_extra"))
    f = _beside(f, repeated, ["_s", "shape"]).withColumn("extra", F.greatest(F.lit(0), F.coalesce("_extra", F.lit(0)))).drop("_extra")
    for name, e in SHAPING.items():
        f = f.withColumn(name, F.expr(for_spark(e)))
    f = written(f, "shaped")
    keys = ["score_a", "o", "v", "inter"]
    total = f.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority") == 3).alias("top"))
    stay = F.when(F.col("top") > F.ceil(F.col("n") * TOP_SHARE), F.ceil(F.col("n") * TOP_STAYS)).otherwise(F.col("top"))
    tops = f.where("priority = 3")
    by = tops.groupBy("_s", *keys).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("_s").orderBy(F.col("score_a").desc(), "o", F.col("v").desc(), F.col("inter").desc()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.join(total, "_s").select("_s", *keys, "k", (stay - F.coalesce(F.sum("k").over(w), F.lit(0))).alias("_quota"))
    by = by.select("_s", *keys, F.greatest(F.lit(0), F.least("_quota", "k")).alias("_quota"), "k")
    tops = _beside(tops.select("_s", *keys, "doc_id", "pos"), by, ["_s", *keys])
    # of the one group of a source that is cut, blocks of documents are counted first
    cut = written(tops.where("_quota > 0 AND _quota < k").withColumn("_block", F.shiftright("doc_id", _DOCS_BITS)), "cut")
    blocks = cut.groupBy("_s", *keys, "_block", "_quota").agg(F.count(F.lit(1)).alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy("_s", *keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_s", *keys, "_block", (F.col("_quota") - before).alias("_here"))
    cut = _beside(cut, blocks, ["_s", *keys, "_block"])
    rank = F.row_number().over(Window.partitionBy("_s", *keys, "_block").orderBy("doc_id", "pos"))
    lost = cut.withColumn("_rank", rank).where(F.col("_rank") > F.col("_here")).select("doc_id", "pos").unionByName(tops.where("_quota = 0").select("doc_id", "pos"))
    return f.join(lost.withColumn("capped", F.lit(True)), ["doc_id", "pos"], "left").withColumn("capped", F.coalesce("capped", F.lit(False))).drop("_s")


def normalize_raw(records: DataFrame, key: str | Column = "fact") -> DataFrame:
    """Every fact of records with what became of it and why, stage by stage.

    records: doc_id, pos (together unique) and READ, as of `with_record`.  A fact is dropped by the first rule that it
    fails; of those that pass, the first of each key goes on and stands for the others; shaping lowers priorities of
    repeated shapes and of a source's tops beyond the cap.  Returned: doc_id, pos, id, status (dropped, merged or
    final), drop_reason, into_doc and into_pos (what stands for a merged fact), merged (the facts a final one stands
    for), scored, shaped and priority (after each stage), demoted (the stage that took priority, or null), layer, and
    stages, the way in words.  A fact with an empty key that passes is merged with others such; no facts give no rows.
    """
    name = F.lower(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")))
    rows = written(records.select("doc_id", F.col("pos").cast("bigint").alias("pos"), *READ, name.alias("key")), "records")
    heads = rows.where("drop_reason IS NULL").groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("merged"))
    heads = written(heads.select("key", F.col("first.doc_id").alias("into_doc"), F.col("first.pos").alias("into_pos"), "merged"), "heads")
    is_first = (F.col("doc_id") == F.col("into_doc")) & (F.col("pos") == F.col("into_pos"))
    # each kept fact meets its key's row: partial counts above bound what is shuffled here to the rows themselves
    kept = written(rows.where("drop_reason IS NULL").join(heads, "key"), "kept")
    final = shaped(kept.where(is_first).select("doc_id", "pos", *READ)).select("doc_id", "pos", F.col("priority").alias("_shaped"), "capped", F.col("extra").alias("_extra"))
    kept = kept.select("doc_id", "pos", "key", "into_doc", "into_pos", "merged", *READ).join(final, ["doc_id", "pos"], "left")
    none = {c: F.lit(None).cast("bigint").alias(c) for c in ("into_doc", "into_pos", "merged", "_shaped", "_extra")}
    gone = rows.where("drop_reason IS NOT NULL").select("doc_id", "pos", "key", *READ, *none.values(), F.lit(None).cast("boolean").alias("capped"))
    both = kept.unionByName(gone)
    status = F.when(F.col("drop_reason").isNotNull(), "dropped").when(is_first, "final").otherwise("merged")
    at_last = F.when(F.col("capped"), 2).otherwise(F.col("_shaped"))
    demoted = F.concat_ws("+", F.when(F.col("_shaped") < F.col("final_priority"), "repetition"), F.when(F.col("capped"), "cap"))
    out = both.withColumns({"status": status, "at_last": at_last, "demoted": F.nullif(demoted, F.lit(""))})
    on_final = lambda c: F.when(F.col("status") == "final", c)
    stages = F.concat_ws(
        " > ", F.when(F.col("status") == "dropped", F.concat(F.lit("filter: "), "drop_reason")).otherwise("filter: passed"),
        F.when(F.col("status") == "merged", F.concat(F.lit("merge: into "), F.col("into_doc").cast("string"), F.lit("/"), F.col("into_pos").cast("string"))).when(F.col("status") == "final", F.concat(F.lit("merge: first of "), F.col("merged").cast("string"))),
        on_final(F.concat(F.lit("score: "), F.col("final_priority").cast("string"))), on_final(F.concat(F.lit("shape: "), F.coalesce("demoted", F.lit("kept")), F.lit(" "), F.col("at_last").cast("string"))), on_final(F.concat(F.lit("layer: "), "layer")),
    )
    return out.select(
        "doc_id", "pos", F.substring(F.sha1(F.concat_ws("|", "key", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"), F.col("pos").cast("string")).cast("binary")), 1, 12).alias("id"), "status", "drop_reason",
        F.when(F.col("status") == "merged", F.col("into_doc")).alias("into_doc"), F.when(F.col("status") == "merged", F.col("into_pos")).alias("into_pos"), on_final(F.col("merged")).alias("merged"),
        on_final(F.col("final_priority")).cast("bigint").alias("scored"), on_final(F.col("_shaped")).cast("bigint").alias("shaped"), on_final(F.col("at_last")).cast("bigint").alias("priority"), "demoted", on_final(F.col("layer")).alias("layer"), stages.alias("stages"))
