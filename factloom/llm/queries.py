"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, content_sort, language, licences, mixing, near_dup, prefix_trie, quality, secrets, slot_merkle, subword_lattice, toxicity, transport_stream
from factloom.llm.common import fold, materialise, table


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the pattern that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _held_out(modulus: int, remainder: int) -> Column:
    """Whether labels of a row are kept from the fit; no row without a doc_id is."""
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in documents, false positives marked; the secrets themselves only as digests."""
    model = secrets.fit_secrets(secrets.labelled_findings(spark))
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "start", "end", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "is_secret")


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    tagged = toxicity.tag_toxicity(docs, model)
    return tagged.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; fitted on labels whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return quality.score_quality(docs, model, "score").select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_sort_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_digests(table(spark, sf_dir, "documents"))


def op7_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), *tokenizer())


def op9_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where(fold("doc_id", 4) != 2))
    return language.identify(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score", "spans")


#: Target weights of the mixing query and the pipeline: one domain twice as much as the others, English half as
#: much again as other languages; sources of a language alike.
MIX_WEIGHTS = {("d0",): 2.0, **{(d, "en"): 1.5 for d in ("d0", "d1", "d2", "d3")}}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, MIX_WEIGHTS, fraction=0.6, max_epochs=2)
    return mixed.select("doc_id", "source", "lang", F.col("mix_epoch").cast("int").alias("mix_epoch"), "mix_tokens")


def op11_slot_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where 5 divides the crc32 of doc_id, the leaf that is folded has its A-Z lower-cased."""
    return slot_merkle.merkle_manifest(table(spark, sf_dir, "documents"), {"text": slot_merkle.ascii_lower("text")}, fold("doc_id", 5) == 0)


#: crc32 of the decimal text of {0}: bit by bit, over the characters.
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i]))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source AS g, doc_id::VARCHAR AS id, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS fields, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), h AS (
    SELECT doc_id, g, id, sha256(head || t) AS leaf, CASE WHEN {CRC32_SQL.format('id')} % 5 = 0 THEN sha256(head || u) ELSE sha256(head || t) END AS other
    FROM (SELECT *, array_to_string(list_transform(fields, lambda f: coalesce(strlen(f)::VARCHAR || ':' || f, '-')), '') AS head,
                 coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS t, coalesce(strlen(low)::VARCHAR || ':' || low, '-') AS u FROM d)
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h
), tree(level, g, pos, n, digest) AS (
    SELECT 0, g, pos, n, leaf FROM leaves
    UNION ALL SELECT level + 1, g, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, g, pos // 16, (n + 15) // 16
), subs AS (
    SELECT g, level AS height, digest AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, pos, n, digest) AS (
    SELECT 0, pos, n, subroot FROM subs
    UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16, (n + 15) // 16
), sides AS (
    SELECT false AS up, level, g, pos, coalesce(string_agg(digest, '') OVER l, '') AS lhs, coalesce(string_agg(digest, '') OVER r, '') AS rhs FROM tree WHERE n > 1
    WINDOW l AS (PARTITION BY level, g, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY level, g, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    UNION ALL
    SELECT true, level, NULL, pos, coalesce(string_agg(digest, '') OVER l, ''), coalesce(string_agg(digest, '') OVER r, '') FROM top WHERE n > 1
    WINDOW l AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), steps AS (
    SELECT l.g, l.pos, s.level AS k, s.lhs, s.rhs FROM leaves l JOIN sides s ON NOT s.up AND s.g IS NOT DISTINCT FROM l.g AND s.pos = l.pos // (16 ** s.level)::BIGINT
    UNION ALL
    SELECT l.g, l.pos, u.height + s.level, s.lhs, s.rhs FROM leaves l JOIN subs u ON u.g IS NOT DISTINCT FROM l.g JOIN sides s ON s.up AND s.pos = u.pos // (16 ** s.level)::BIGINT
), fold(g, pos, k, digest) AS (
    SELECT g, pos, 0, other FROM leaves
    UNION ALL SELECT f.g, f.pos, f.k + 1, sha256(s.lhs || f.digest || s.rhs) FROM fold f JOIN steps s ON s.g IS NOT DISTINCT FROM f.g AND s.pos = f.pos AND s.k = f.k
), proofs AS (SELECT g, pos, string_agg(lhs || rhs, '' ORDER BY k) AS siblings, count(*) AS height FROM steps GROUP BY g, pos),
whole AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, u.subroot, w.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = w.root AS verified
FROM leaves l JOIN subs u ON u.g IS NOT DISTINCT FROM l.g CROSS JOIN whole w LEFT JOIN proofs p ON p.g IS NOT DISTINCT FROM l.g AND p.pos = l.pos
JOIN fold f ON f.g IS NOT DISTINCT FROM l.g AND f.pos = l.pos AND f.k = coalesce(p.height, 0)
"""


def piece_vocabulary() -> str:
    """Path of the vocabulary whose pieces the language model weighs."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32(doc_id) mod 7 is not 2."""
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    scores = subword_lattice.lattice_scores(table(spark, sf_dir, "documents"), ~held_out, piece_vocabulary())
    return scores.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def rebranched(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with turns of the first one of their `every`: the first h of its turns, h being
    crc32(conv_id) mod `most`, then the own turns after the first h.  Where that one is absent, nothing comes before."""
    heads = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    own = sequences.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % every, "_h": fold("conv_id", most).cast("int")})
    none = F.array().cast(sequences.schema["turns"].dataType)
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))).otherwise(none)
    return own.join(heads, "_base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = materialise(prefix_trie.turn_sequences(table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie.prefix_trie(rebranched(sequences))


OP13_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, sha256(strlen(r)::VARCHAR || ':' || r || x) AS id, length(x) AS chars FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), s AS (SELECT conv_id, list({{'id': id, 'chars': chars}} ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv_id
), c AS (SELECT *, conv_id - conv_id % 100 AS base, {CRC32_SQL.format('id')} % 6 AS h FROM (SELECT *, conv_id::VARCHAR AS id FROM s)
), r AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN s b ON b.conv_id = c.base
), p AS (SELECT conv_id, d, len(turns) = d AS ends, CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars, md5(array_to_string(list_transform(turns[1:d], lambda u: u.id), '')) AS node,
                list_transform(range(0, d + 1), lambda k: md5(array_to_string(list_transform(turns[1:k], lambda u: u.id), ''))) AS above FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)
), n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, any_value(above) AS above, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY node, d
), k AS (SELECT m.node, count(x.node) AS n_children FROM n m LEFT JOIN n x ON x.d = m.d + 1 AND x.above[m.d + 1] = m.node GROUP BY m.node
), u AS (SELECT up AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM (SELECT n.*, k.n_children, unnest(above) AS up FROM n JOIN k USING (node)) GROUP BY up)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN k USING (node) JOIN u USING (node) LEFT JOIN n q ON n.d > 0 AND q.node = n.above[n.d]
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_forest, op2_toxicity_crf, op3_quality_cotraining, op4_content_sort_dedup, op5_minhash_near_dup, op6_transport_streams, op7_licence_sentences, op8_byte_bpe, op9_language_viterbi, op10_mixing, op11_slot_merkle, op12_subword_lattice, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_content_sort_dedup": OP4_SQL, "op11_slot_merkle": OP11_SQL, "op13_prefix_trie": OP13_SQL}
