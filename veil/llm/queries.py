"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import block_names, bpe, caps, centroids, chat, importance, licences, mixing, pii, quality, simhash, token_counts, toxicity
from veil.llm.common import crc_bucket, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.public_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, ranks, pattern), ranks)
    return both.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    return chat.read_back(chat.formatted(given.unionByName(spark.createDataFrame(both, given.schema))))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality.scored(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.KEEP).cast("int").alias("predicted"),
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = mixing.sizes(docs).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "size")
    mix = mixing.copies(slim)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.scored(docs, weights).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"),
    )


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"), licences.known_digests(spark))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.counted(docs, token_counts.public_model(), limit=4096)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_chat_format": op2_chat_format,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_pii": op5_pii,
    "op6_source_mix": op6_source_mix,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_licence_scan": op10_licence_scan,
    "op11_token_counts": op11_token_counts,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), marked AS (
            SELECT *, CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' ELSE '<</TURN>>' END AS stop,
                CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 7 WHEN 'assistant' THEN 3
                    ELSE 9 + length(regexp_replace(role, '([\\>])', '\\\1', 'g')) END + length(stop) AS marks,
                '<\\*(?:/?s>|<SYS>>|</SYS>>|<TURN |</TURN>>)|\[\\*/?INST\]' AS control,
                '<\\+(?:/?s>|<SYS>>|</SYS>>|<TURN |</TURN>>)|\[\\+/?INST\]' AS hidden
            FROM given
        ), rendered AS (
            SELECT *, marks + length(text) + CASE WHEN contains(text, stop) OR regexp_matches(text, hidden)
                THEN len(regexp_extract_all(text, control)) ELSE 0 END AS chars
            FROM marked
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM rendered GROUP BY conv_id
    """,
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(text) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY text)
    """,
    "op10_licence_scan": licences.oracle_sql(),
    "op12_centroid_clustering": centroids.oracle_sql(),
}
