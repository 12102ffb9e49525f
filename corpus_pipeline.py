"""A training-data pipeline: quality filter, exact and near deduplication, source mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
A stage reads its documents as a written table, as `run` and the check tool give it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import block_names, bpe, mixing, near_copies, quality
from veil.llm.common import crc_bucket, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; the same labels are held out as in its query."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 5) != 0))
    return quality.scored(docs, model, out="__score").filter(F.col("__score") >= quality.KEEP).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return block_names.deduplicated(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, Jaccard similarity of at least 0.8), the document with the smallest doc_id."""
    return near_copies.representatives(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(mixing.mixed(docs, prefix="__mix_"), docs.columns, "__mix_copies")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text's bytes."""
    ranks, pattern = bpe.public_vocabulary()
    slim = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    both = bpe.decode(bpe.encode(slim, ranks, pattern), ranks)
    return both.select(
        "doc_id", "source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids",
        (F.sha2("bytes", 256) == F.col("text_sha256")).alias("exact"),
    )


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_documents),
    ("simhash_near_dedup", dissimilar_documents),
    ("source_mix", mixed_documents),
    ("byte_bpe", token_ids),
]

#: Trained scores, fingerprints and merges have no SQL text; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
