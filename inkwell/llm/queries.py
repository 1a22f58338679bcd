"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embed_dedup, lang_id, lexical, licenses, mixing, order_minhash, packing, personal, preference, prefix_trie, quality, secrets

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from those not held out."""
    return lang_id.predict(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts in every whole document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected."""
    return preference.paired_by_id(table(spark, sf_dir, "conversations"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole document, learned from labels not held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: known shapes and high-entropy strings."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets, in training order."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("position", F.round("position", 6))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more between all embeddings, and their components."""
    return embed_dedup.links(table(spark, sf_dir, "embeddings"))


def op10_ann_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours of every twentieth embedding."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document, by anchors and local parsers."""
    return personal.scan(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_license_scans,
        op3_preference_formatting,
        op4_best_fit_packing,
        op5_quality_classifier,
        op6_order_minhash,
        op7_secret_scans,
        op8_curriculum_mixing,
        op9_embedding_dedup,
        op10_ann_ivf_pq,
        op11_personal_data,
        op12_ranked_search,
        op13_conversation_trie,
    )
}
SQL: dict[str, str] = {"op7_secret_scans": secrets.SQL, "op8_curriculum_mixing": mixing.SQL, "op3_preference_formatting": preference.SQL, "op12_ranked_search": lexical.SQL, "op13_conversation_trie": prefix_trie.SQL}
