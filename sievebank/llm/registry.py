"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import balanced_shards, context_trees, image_copies, pattern_packing, pii_surrogates, piece_codec, quality_rules, seekable_warc, simhash, suffix_dedup
from .common import read


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), count_column="n_mentions")


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(read(spark, sf_dir, "documents"))


def op3_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_trees.score(read(spark, sf_dir, "documents"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seekable_warc.round_trip(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints_linked(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards.shard_by_bytes(read(spark, sf_dir, "documents"))


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies.find_copies(image_copies.pictures(read(spark, sf_dir, "embeddings")))


def queries() -> dict:
    own = (op1_pii_surrogates, op2_sentencepiece_codec, op3_context_tree_scores, op4_warc_bundles, op5_simhash, op6_quality_rules, op7_pattern_packing, op8_suffix_dedup, op9_byte_shards, op10_image_copies)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_bundles": seekable_warc.ORACLE_SQL}
